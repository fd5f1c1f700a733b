"""Main-text extraction with a linear-chain conditional random field over leaf blocks.

A page is a sequence of leaf blocks. Each block has features of its ancestors
(tags, names in class, id and role) and of its text (length, links,
punctuation); neighbouring labels are tied by transition weights. The field is
trained on labelled pages by maximum likelihood with exact forward-backward
sums, and pages are decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mobilis.llm.html_blocks import Block, blocks
from mobilis.llm.html_labelled import labelled_pages

TRAIN_PAGES = 700
SEED = 11


@dataclass
class Field:
    """Weights for "main" against "other": by feature, and transitions [from][to] with 0 other, 1 main."""

    weights: dict[str, float]
    start: float
    moves: list[list[float]]


def path_features(path: tuple) -> list[str]:
    found = {f"tag={tag}" for tag, _ in path} | {f"name={n}" for _, names in path for n in names}
    return sorted(found | {f"in={path[-1][0]}"} if path else found)


def text_features(block: Block) -> list[str]:
    n, text = len(block.text.split()), block.text
    size = "1" if n < 2 else "2-4" if n < 5 else "5-9" if n < 10 else "10-24" if n < 25 else "25-"
    links = block.linked / max(1, len(text))
    found = [f"words={size}", "links=" + ("none" if not links else "some" if links < 0.5 else "most")]
    if text[-1] in ".!?…":
        found.append("stop")
    if "©" in text or "|" in text or "·" in text:
        found.append("sign")
    return found


def fit(pages: list[tuple[list[Block], list[bool]]], steps: int = 250, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with Adam; ``pages`` are labelled block sequences."""
    index: dict[str, int] = {}
    rows, columns, at = [], [], []
    width = max(len(b) for b, _ in pages)
    gold, real = np.zeros((len(pages), width), int), np.zeros((len(pages), width), bool)
    for p, (page, labels) in enumerate(pages):
        for t, (block, label) in enumerate(zip(page, labels, strict=True)):
            for f in path_features(block.path) + text_features(block):
                rows.append(len(at))
                columns.append(index.setdefault(f, len(index)))
            at.append((p, t))
            gold[p, t], real[p, t] = label, True
    rows, columns, (pp, tt) = np.array(rows), np.array(columns), np.array(at).T
    params = [np.zeros(len(index)), np.zeros(1), np.zeros((2, 2))]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    pairs = real[:, 1:]
    gold_moves = np.array([[(pairs & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for step in range(1, steps + 1):
        w, start, moves = params
        score = np.zeros((len(pages), width, 2))
        score[pp, tt, 1] = np.bincount(rows, w[columns], len(at))
        score[:, 0, 1] += start[0]
        left, right = score.copy(), np.zeros_like(score)
        for t in range(1, width):  # past a page's end, sums are carried on unchanged
            into = score[:, t] + np.logaddexp(left[:, t - 1, 0, None] + moves[0], left[:, t - 1, 1, None] + moves[1])
            left[:, t] = np.where(real[:, t, None], into, left[:, t - 1])
        for t in range(width - 2, -1, -1):
            ahead = right[:, t + 1] + score[:, t + 1]
            back = np.logaddexp(moves[:, 0] + ahead[:, 0, None], moves[:, 1] + ahead[:, 1, None])
            right[:, t] = np.where(real[:, t + 1, None], back, 0.0)
        total = np.logaddexp(left[:, -1, 0], left[:, -1, 1])
        main = np.exp(left[..., 1] + right[..., 1] - total[:, None])
        both = np.exp(left[:, :-1, :, None] + moves + (score + right)[:, 1:, None, :] - total[:, None, None, None])
        error = main[pp, tt] - gold[pp, tt]
        grads = [np.bincount(columns, error[rows], len(index)) / len(pages) + decay * w,
                 np.array([(main[:, 0] - gold[:, 0]).mean()]),
                 ((both * pairs[..., None, None]).sum(axis=(0, 1)) - gold_moves) / len(pages) + decay * moves]
        for x, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Field({f: float(params[0][k]) for f, k in index.items()}, float(params[1][0]), params[2].tolist())


def train(count: int = TRAIN_PAGES, seed: int = SEED) -> Field:
    return fit([(blocks(html), labels) for html, labels in labelled_pages(count, seed)])


def viterbi(scores: list[float], field: Field) -> list[bool]:
    """The best labelling of a page, given each block's score for "main"."""
    if not scores:
        return []
    (oo, om), (mo, mm) = field.moves
    other, main, back = 0.0, scores[0] + field.start, []
    for s in scores[1:]:
        back.append((main + mo > other + oo, main + mm > other + om))
        other, main = max(other + oo, main + mo), s + max(other + om, main + mm)
    labels = [main > other]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def main_text(html: str | None, field: Field, known: dict | None = None) -> str:
    """The main blocks of a page, joined by two line ends. ``known`` keeps the scores of ancestor paths."""
    known = {} if known is None else known
    weights, scores, page = field.weights, [], blocks(html)
    for b in page:
        if b.path not in known:
            known[b.path] = sum(weights.get(f, 0.0) for f in path_features(b.path))
        scores.append(known[b.path] + sum(weights.get(f, 0.0) for f in text_features(b)))
    return "\n\n".join(b.text for b, main in zip(page, viterbi(scores, field), strict=True) if main)


def html_extract(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text, n_chars) per input row.

    ``pages`` needs page_id, url and html; other columns are ignored whatever
    their names. Null or empty html, and pages without a main block, give the
    empty text. Ids and urls are passed on, nulls too. Repeated rows get the
    same answer each. Broken markup is read as far as it goes.
    """
    rows = pages.select("page_id", "url", "html")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator):
        import pyarrow as pa

        known: dict = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # bounded output, however long the pages
                part = batch.slice(k, 256)
                if len(known) > 100_000:
                    known.clear()
                texts = [main_text(x, field, known) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


