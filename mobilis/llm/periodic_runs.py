"""Periodic runs of words: stretches that repeat with a period, at least ``exponent`` times.

A run of period q and at least ``exponent`` times q words (4 unless told
otherwise) holds ``exponent`` consecutive points of the grid 0, q, 2q, ... that
agree. These points,
over all q a harmonic number of them, are compared first. What is left is
extended forwards and backwards by longest common extensions, from a sort of
the positions in a difference cover only. A stretch found under several
periods keeps the smallest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mobilis.llm.lce import Extensions

MIN_LENGTH, EXPONENT = 6, 4
#: Bytes of text that are worked on together; a longer text is worked on alone.
SLICE = 2 << 20
#: Grid points looked at together.
POINTS = 1 << 21

_RUN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")])
_FOUND = [T.StructField("n_words", T.LongType(), False),
          T.StructField("runs", T.ArrayType(_RUN, False), False),
          T.StructField("collapsed", T.StringType(), False)]


def _grid(ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, period) where exponent - 1 consecutive grid points of the period agree with their successors."""
    periods = sizes // exponent  # the largest possible one of each text
    texts = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(texts)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (sizes[texts] - 1) // period - (exponent - 2)
    ends = np.cumsum(count)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + POINTS, "right")))
        n, q = count[first:last], period[first:last]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q, text = np.repeat(q, n), np.repeat(texts[first:last], n)
        place = begin[text] + k * q
        keep = np.flatnonzero(ids[place] == ids[place + q])
        for step in range(1, exponent - 1):
            text, place, q = text[keep], place[keep], q[keep]
            keep = np.flatnonzero(ids[place + step * q] == ids[place + (step + 1) * q])
        yield text[keep], place[keep], q[keep]
        first = last


def find_runs(ids: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[np.ndarray]:
    """(text, start, length, period) of all runs, ordered by text, start and period.

    ``ids`` are the words of all texts as integers from 0, ``ends`` (from 0 on)
    where texts begin and end. ``exponent`` must be 2 or more.
    """
    if exponent < 2:
        raise ValueError("exponent must be 2 or more")
    begin, sizes = ends[:-1], np.diff(ends)
    points = list(_grid(ids, begin, sizes, exponent))
    if not sum(len(x[0]) for x in points):
        return [np.empty(0, np.int64)] * 4
    text, place, period = (np.concatenate(x) for x in zip(*points, strict=True))
    # The texts with points left, each between two values that occur nowhere else.
    chosen = np.unique(text)
    size = sizes[chosen]
    shifted = np.cumsum(size + 1) - size  # where each begins in the new array
    values = np.empty(size.sum() + len(size) + 1, np.int64)
    inside = np.ones(len(values), bool)
    marks = np.append(shifted - 1, len(values) - 1)
    inside[marks] = False
    values[marks] = ids.max(initial=0) + 2 + np.arange(len(marks))
    values[inside] = ids[np.repeat(begin[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())] + 1
    forward, backward, end = Extensions(values), Extensions(values[::-1]), len(values) - 1
    which = np.searchsorted(chosen, text)
    at = shifted[which] + place - begin[text]
    found = []
    for k in range(0, len(at), POINTS):
        p, q, w = at[k:k + POINTS], period[k:k + POINTS], which[k:k + POINTS]
        after = forward(p, p + q)
        before = backward(end - (p - 1), end - (p + q - 1))
        length = before + q + after
        keep = length >= np.maximum(min_length, exponent * q)
        found.append(np.stack([w[keep], (p - before - shifted[w])[keep], length[keep], q[keep]]))
    w, start, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, start, w))
    w, start, length, q = w[order], start[order], length[order], q[order]
    new = np.ones(len(w), bool)  # of one stretch, the smallest period
    new[1:] = (w[1:] != w[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    w, start, length, q = w[new], start[new], length[new], q[new]
    order = np.lexsort((q, start, w))
    return [chosen[w[order]], start[order], length[order], q[order]]


def kept_words(ends: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for each word that a run contains after its first period."""
    edge = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(edge, ends[text] + start + period, 1)
    np.add.at(edge, ends[text] + start + length, -1)
    return np.cumsum(edge[:-1]) == 0


def _work(texts, min_length: int, exponent: int):
    """(n_words, runs, collapsed) columns of an Arrow array of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten().dictionary_encode()
    ids, vocabulary = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    ends = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    empty = pc.index(vocabulary, "").as_py()  # what a split leaves before the first and behind the last blank
    if empty >= 0:
        word = ids != empty
        ends, ids = np.concatenate([[0], np.cumsum(word)])[ends], ids[word]
    text, start, length, period = find_runs(ids, ends, min_length, exponent)
    keep = kept_words(ends, text, start, length, period)
    kept_ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    kept = pa.ListArray.from_arrays(pa.array(kept_ends.astype(np.int32)), vocabulary.take(pa.array(ids[keep])))
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=[
        pa.field(x, pa.int64(), False) for x in ("start", "length", "period")])
    per_text = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(ends))).astype(np.int32)), runs)
    return pa.array(np.diff(ends)), per_text, pc.binary_join(kept, " ")


def _slices(sizes: np.ndarray, bound: int) -> Iterator[tuple[int, int]]:
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + bound, "right")))
        yield first, last - first
        first = last


def periodic_runs(docs: DataFrame, text: Column | None = None, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per input row.

    ``docs`` needs doc_id (any type, null allowed) and text (or the column
    given); further columns are ignored whatever their names. Words are what
    ASCII blanks separate. ``runs`` lists (start, length, period), ordered by
    start and period: longest stretches of ``min_length`` or more words, at
    least ``exponent`` times their smallest period. ``collapsed`` is the text
    without the words that a run contains after its first period, joined by
    one space. Null or blank text has no words, no runs and collapses to the
    empty text. Repeated rows come back as often as they occur; an empty table
    gives an empty result. A task holds 2 MB of text or one longer text at a
    time, and memory in proportion to it.
    """
    def run(batches: Iterator):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for first, n in _slices(pc.binary_length(batch.column("_t")).to_numpy(zero_copy_only=False), SLICE):
                part = batch.slice(first, n)
                columns = _work(part.column("_t").cast(pa.string()), min_length, exponent)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select("doc_id", F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("_t"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *_FOUND]))
