"""Removal of long byte strings that occur more than once.

A string of ``length`` bytes is removed wherever it starts, if it also starts
anywhere else. Each window of that length is represented by an anchor: the
position inside it whose hash of the next ``gram`` bytes is smallest. Equal
windows have the same anchor in the same place, so only anchors whose gram
occurs twice or more can lead to equal windows, and few positions are anchors.
The texts around these are sorted by a deep-shallow suffix sort, once by what
follows the anchor and once by what precedes it. The common prefixes of
neighbours then tell for every window which others it equals: two windows that
begin d bytes before their anchors are equal if what precedes agrees on d bytes
and what follows on the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mobilis.llm.common import shuffle_partitions, stored
from mobilis.llm.shingles import mixed
from mobilis.llm.suffix_sort import deep_shallow_order, prefix_lengths

LENGTH, GRAM = 400, 128
#: Bytes that are hashed together, below 2 ** 20.
SLICE = 1 << 19
#: Anchors with one gram that are sorted in one task. Of more, blocks of this size are sorted, and the
#: different windows of the blocks are compared by digest.
BLOCK = 50_000
#: Anchors that are worked on together at least.
BATCH = 8_000
_PLACE = np.uint64((1 << 20) - 1)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _doubling(x: np.ndarray, size: int, join) -> np.ndarray:
    """join over every run of ``size`` elements, from runs of powers of two."""
    have, runs, out, done = 1, x, None, 0
    while True:
        if size & have:
            n = len(x) - done - have + 1
            out = runs[done:done + n] if out is None else join(out[:n], runs[done:done + n], have)
            done += have
        if 2 * have > size:
            return out
        n = len(runs) - have
        runs = join(runs[:n], runs[have:], have)
        have *= 2


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    base, wrap = 0x9E3779B97F4A7C15 | 1, 1 << 64
    return mixed(_doubling(_BYTES[data], gram, lambda a, b, n: a * np.uint64(pow(base, n, wrap)) + b))


def anchors(blobs: list[bytes], length: int, gram: int) -> list[np.ndarray]:
    """(text, anchor, first window, last window, gram hash) of every run of windows with the same anchor."""
    found, part, size = [], [], 0
    for text, blob in enumerate(blobs):
        for at in range(0, max(1, len(blob) - length + 1), SLICE - length):  # the windows that start here, whole
            piece = blob[at:at + SLICE - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > SLICE:
                found.append(_slice_anchors(part, length, gram))
                part, size = [], 0
            part.append((text, at, piece))
            size += len(piece)
    found.append(_slice_anchors(part, length, gram))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _slice_anchors(part: list[tuple[int, int, bytes]], length: int, gram: int) -> list[np.ndarray]:
    if not part:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)]
    data = np.frombuffer(b"".join([p for _, _, p in part]), np.uint8)
    hashes = gram_hashes(data, gram)
    ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
    lowest = _doubling(ranked, length - gram + 1, lambda a, b, n: np.minimum(a, b))
    sizes = np.array([len(p) for _, _, p in part])
    begin = np.cumsum(sizes) - sizes
    # Consecutive pieces of one text overlap; a window belongs to the piece in whose first part it starts.
    count = np.minimum(sizes - length + 1, SLICE - length)
    start = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    owner = np.repeat(np.arange(len(part)), count)
    low = lowest[start]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(low)]]) - 1
    place = (low[first] & _PLACE).astype(np.int64)
    texts, offsets = np.array([t for t, _, _ in part]), np.array([a for _, a, _ in part])
    who = owner[first]
    shift = offsets[who] - begin[who]
    return [texts[who], place + shift, start[first] + shift, start[last] + shift, hashes[place]]


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                text, place, first, last, hashes = anchors([t.encode() for t in part.column("_t").to_pylist()], length, gram)
                ends = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place, first, last, hashes.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "sha", "n_bytes")), *lists],
                                                 names=["doc_id", "sha", "n_bytes", "place", "first", "last", "gram"])
    return run


def _contexts(length: int):
    """Bytes of all windows of an anchor, for each wanted anchor of a text."""
    def run(batches: Iterator):
        import pyarrow as pa

        names = ["gram", "blocks", "sha", "first", "before", "around"]
        for batch in batches:
            for row in range(batch.num_rows):
                text, sha = batch.column("_t")[row].as_py().encode(), batch.column("sha")[row].as_py()
                wanted = batch.column("wanted")[row].as_py()
                for k in range(0, len(wanted), 4096):
                    part = wanted[k:k + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w["gram"] for w in part], pa.int64()), pa.array([w["blocks"] for w in part], pa.int32()),
                         pa.array([sha] * len(part), pa.binary()), pa.array([w["first"] for w in part], pa.int64()),
                         pa.array([w["place"] - w["first"] for w in part], pa.int32()),
                         pa.array([text[w["first"]:w["last"] + length] for w in part], pa.binary())], names=names)
    return run


def repeated_windows(around: list[bytes], before: np.ndarray, starts: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows by (string, bytes before the anchor): whether another is equal, and whether one is the first of its kind.

    ``around`` has the strings of all groups, ``before`` where the anchor is in
    each, ``starts`` where groups start, and the end.
    """
    n, reach = len(around), int(before.max()) + 1
    after = np.array([len(a) for a in around]) - before
    edges = set(starts)
    classes = []
    for side in ([a[b:] for a, b in zip(around, before, strict=True)], [a[:b][::-1] for a, b in zip(around, before, strict=True)]):
        order = deep_shallow_order(side, starts)
        classes.append((order, prefix_lengths(side, order, edges), np.empty(n, np.int64)))
    edge = np.zeros(n, bool)
    edge[starts[:-1]] = True
    twice, lead = np.zeros((n, reach), bool), np.zeros((n, reach), bool)
    for d in range(reach):
        rows = np.flatnonzero((before >= d) & (after >= length - d))
        if not len(rows):
            continue
        for (order, lcp, out), depth in zip(classes, (length - d, d), strict=True):
            out[order] = np.cumsum((lcp < depth) | edge)
        key = classes[0][2][rows] * np.int64(n + 1) + classes[1][2][rows]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
        lead[rows[order[~same]], d] = True
        same |= np.concatenate([same[1:], [False]])
        twice[rows[order[same]], d] = True
    return twice, lead


def _find_repeats(length: int):
    """Reads anchors sorted by (gram, block); writes spans, and windows of grams that fill several blocks."""
    def work(rows: list[tuple]):
        import hashlib

        import pyarrow as pa

        starts = [k for k, r in enumerate(rows) if not k or r[:2] != rows[k - 1][:2]] + [len(rows)]
        before, around = np.array([r[5] for r in rows]), [r[6] for r in rows]
        twice, lead = repeated_windows(around, before, starts, length)
        padded = np.pad(twice, ((0, 0), (1, 1))).astype(np.int8)
        step = np.diff(padded, axis=1)
        who, low = np.nonzero(step == 1)  # runs of equal windows, low to high bytes before the anchor
        high = np.nonzero(step == -1)[1] - 1
        first = np.array([r[4] for r in rows])
        place = first[who] + before[who]
        shas, begin, end = [rows[w][3] for w in who], (place - high).tolist(), (place - low + length).tolist()
        digests, done = [None] * len(shas), [True] * len(shas)
        for k, r in enumerate(rows):
            if r[2] > 1:
                for d in np.flatnonzero(lead[k]).tolist():
                    at = r[5] - d
                    shas.append(r[3])
                    begin.append(r[4] + at)
                    end.append(r[4] + at + length)
                    digests.append(hashlib.sha256(r[6][at:at + length]).digest())
                    done.append(bool(twice[k, d]))
        return pa.RecordBatch.from_arrays(
            [pa.array(shas, pa.binary()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(digests, pa.binary()), pa.array(done, pa.bool_())],
            names=["sha", "begin", "end", "digest", "done"])

    def run(batches: Iterator):
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "block", "blocks", "sha", "first", "before", "around")), strict=True):
                if len(rows) >= BATCH and row[:2] != rows[-1][:2]:
                    yield work(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield work(rows)
    return run


def _cut(keep_text: bool):
    def run(batches: Iterator):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                removed, runs, digests, texts = [], [], [], []
                for text, spans in zip(part.column("_t").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    blob, at, kept, n = text.encode(), 0, [], 0
                    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
                        if begin > at or not n:
                            kept.append(blob[at:begin])
                            n += 1
                        at = max(at, end)
                    kept.append(blob[at:])
                    rest = b"".join(kept)
                    removed.append(len(blob) - len(rest))
                    runs.append(n)
                    digests.append(hashlib.sha256(rest).hexdigest())
                    texts.append(rest)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)]
                    + [pa.array(texts, pa.binary())] * keep_text,
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, spans): rows (doc_id, sha, n_bytes), classes of equal texts (sha, copies), and spans (sha, spans) inside a text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    named = rows.select("doc_id", F.unhex(F.sha2("_t", 256)).alias("sha"), F.octet_length("_t").cast("long").alias("n_bytes"), "_t")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(named.mapInArrow(_find_anchors(length, gram), f"doc_id {kind}, sha binary, n_bytes bigint, place array<bigint>, "
                                    "first array<bigint>, last array<bigint>, gram array<bigint>"), "suffix-anchors")
    # Equal texts are one text with a count: where there are two, all of it is repeated.
    classes = stored(found.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"),
                                              *(F.first(c).alias(c) for c in ("place", "first", "last", "gram")))
                     .withColumn("cid", F.xxhash64("sha")), "suffix-classes")
    each = classes.select("cid", F.posexplode("gram").alias("i", "gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("gram", F.ceil(F.col("_c") / block).cast("int").alias("blocks"))
    wanted = each.join(often, "gram").groupBy("cid").agg(F.collect_set(F.struct("i", "blocks")).alias("_w"))  # at most a text's anchors

    def anchor(w):
        return F.struct(*(F.get(F.col(c), w["i"]).alias(c) for c in ("place", "first", "last", "gram")), w["blocks"].alias("blocks"))

    wanted = classes.join(wanted, "cid").select("doc_id", "sha", F.transform("_w", anchor).alias("wanted"))
    texts = named.select("doc_id", "sha", "_t").alias("t").join(
        wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.sha") == F.col("w.sha")))
    around = texts.select("t.sha", "_t", "wanted").mapInArrow(
        _contexts(length), "gram bigint, blocks int, sha binary, first bigint, before int, around binary")
    around = around.withColumn("block", F.pmod(F.xxhash64("sha", "first"), F.col("blocks")).cast("int"))
    result = stored(around.repartition(shuffle_partitions(docs.sparkSession), "gram", "block").sortWithinPartitions("gram", "block")
                    .select("gram", "block", "blocks", "sha", "first", "before", "around")
                    .mapInArrow(_find_repeats(length), "sha binary, begin bigint, end bigint, digest binary, done boolean"), "suffix-repeats")
    windows = result.where("digest IS NOT NULL")
    across = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("digest")
    spans = result.where("digest IS NULL").union(windows.where("NOT done").join(across, "digest").select(*result.columns))
    spans = spans.groupBy("sha").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return found.select("doc_id", "sha", "n_bytes"), classes.select("sha", "copies"), spans


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the kept bytes.

    ``docs`` needs doc_id and text; other columns are ignored whatever their
    names. Texts are taken as UTF-8 bytes, null as the empty text. Every byte
    that lies in a string of ``length`` bytes which starts at two or more places
    of the table is removed, in all of these places; strings may overlap, and
    are judged on the input. A repeated row is a document of its own, so texts
    that occur in two rows are removed whole (if they have ``length`` bytes).
    An empty table gives an empty result.
    """
    rows, classes, spans = repeated_spans(docs, length, gram, block)
    runs = shuffle_partitions(docs.sparkSession)
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(runs)))
    verdict = classes.join(spans, "sha", "left").where("copies > 1 OR spans IS NOT NULL")
    # Large classes of equal texts: the verdict reaches each run once, then its rows.
    spread = rows.select("run", "sha").distinct().join(verdict.where("copies > 1").select("sha", "copies"), "sha")
    judged = rows.join(spread, ["run", "sha"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    whole = judged.where((F.col("copies") > 1) | (F.col("n_bytes") < length))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    sha = F.lower(F.hex("sha"))
    whole = whole.select("doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"),
                         F.when(gone, F.sha2(F.lit(""), 256)).otherwise(sha).alias("kept_sha256"), "sha")
    single = judged.where((F.col("copies") == 1) & (F.col("n_bytes") >= length)).join(verdict.where("copies = 1").select("sha", "spans"), "sha", "left")
    clean = single.where("spans IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                                                 sha.alias("kept_sha256"), "sha")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).withColumn("sha", F.unhex(F.sha2("_t", 256))).alias("t")
    partly = texts.join(verdict.where("copies = 1 AND spans IS NOT NULL").select("sha", "spans").alias("v"), F.col("t.sha") == F.col("v.sha"))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    extra = [T.StructField("kept", T.BinaryType())] * keep_text
    partly = partly.select("doc_id", F.octet_length("_t").cast("long").alias("n_bytes"), "_t", "spans").mapInArrow(_cut(keep_text), T.StructType(fields + extra))
    plain = whole.unionByName(clean)
    names = [f.name for f in fields]
    if not keep_text:
        return plain.select(names).unionByName(partly)
    kept = plain.join(texts.select(F.col("sha").alias("_s"), "_t").dropDuplicates(["_s"]), F.col("sha") == F.col("_s"))
    kept = kept.select(*names, F.when(F.col("n_removed") > 0, F.lit(b"")).otherwise(F.col("_t").cast("binary")).alias("kept"))
    return kept.unionByName(partly)
