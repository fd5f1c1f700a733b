"""Language identification with a bidirectional gated recurrent network over bytes.

Two gated recurrent units read the bytes of a text, one from each side; at every
position their states give a distribution over the languages. A document's
probabilities are the mean over its positions. The network is trained in numpy
by backpropagation through time on short windows of labelled texts; it reads
nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the training sample: documents per language, characters taken from each (from one place in it).
SAMPLE_DOCS = 200
SAMPLE_CHARS = 600
#: Bytes that the network reads in one go; longer texts are read window by window.
SPAN = 64
HIDDEN = 8
UNKNOWN = "und"
#: Windows that are computed together.
BLOCK = 4096


@dataclass
class Network:
    """For each direction: input weights by byte (256 x 3H), state weights (H x 3H), output weights (H x C)."""

    langs: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    outputs: list[np.ndarray]
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, *self.outputs, self.bias]


def new_network(langs: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    make = lambda rows, cols, s: (rng.standard_normal((rows, cols)) * s).astype(np.float32)
    return Network(langs, [make(256, 3 * hidden, 0.3) for _ in "fb"], [make(hidden, 3 * hidden, hidden ** -0.5) for _ in "fb"],
                   [make(hidden, len(langs), hidden ** -0.5) for _ in "fb"], np.zeros(len(langs), np.float32))


def _unit(x: np.ndarray, h: np.ndarray, u: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step: new state, gates (update, reset; as 0 to 1) and candidate."""
    gates = x[:, :2 * hidden] + h @ u[:, :2 * hidden]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates += 1.0
    gates *= 0.5
    new = np.tanh(x[:, 2 * hidden:] + (h * gates[:, hidden:]) @ u[:, 2 * hidden:])
    return new + gates[:, :hidden] * (h - new), gates, new


def forward(net: Network, spans: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Probabilities (positions x windows x languages) for windows of bytes; mask is 0 past a text's end."""
    n, width = spans.shape
    hidden = net.states[0].shape[0]
    scores = np.empty((width, n, len(net.langs)), np.float32)
    for side, order in ((0, range(width)), (1, range(width - 1, -1, -1))):
        w, u, v = net.inputs[side], net.states[side], net.outputs[side]
        h = np.zeros((n, hidden), np.float32)
        for t in order:
            h, _, _ = _unit(w[spans[:, t]], h, u, hidden)
            if side:
                h *= mask[:, t:t + 1]
                scores[t] += h @ v
            else:
                scores[t] = h @ v
    scores += net.bias
    scores -= scores.max(axis=2, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=2, keepdims=True)
    return scores


def train(spans: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = HIDDEN, steps: int = 350, batch: int = 128,
          rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the mean cross-entropy of all positions; gradients by backpropagation through time."""
    net, rng = new_network(langs, hidden, seed), np.random.default_rng(seed + 1)
    params = net.parameters()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(spans), batch)
        grads = _gradients(net, spans[pick], labels[pick], hidden)
        pace = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, hidden: int) -> list[np.ndarray]:
    n, width = x.shape
    runs = []
    scores = np.zeros((width, n, len(net.langs)), np.float32) + net.bias
    for side, order in ((0, list(range(width))), (1, list(range(width - 1, -1, -1)))):
        h, kept = np.zeros((n, hidden), np.float32), []
        for t in order:
            before = h
            h, gates, new = _unit(net.inputs[side][x[:, t]], before, net.states[side], hidden)
            kept.append((t, before, gates, new, h))
            scores[t] += h @ net.outputs[side]
        runs.append(kept)
    scores -= scores.max(axis=2, keepdims=True)
    error = np.exp(scores)
    error /= error.sum(axis=2, keepdims=True)
    error[:, np.arange(n), y] -= 1
    error /= n * width
    d_in, d_state, d_out = ([np.zeros_like(p) for p in part] for part in (net.inputs, net.states, net.outputs))
    for side, kept in enumerate(runs):
        u, back = net.states[side], np.zeros((n, hidden), np.float32)
        for t, before, gates, new, h in reversed(kept):
            d_out[side] += h.T @ error[t]
            dh = back + error[t] @ net.outputs[side].T
            z, r = gates[:, :hidden], gates[:, hidden:]
            d_new = dh * (1 - z) * (1 - new * new)
            d_reset = d_new @ u[:, 2 * hidden:].T
            d_gates = np.hstack([dh * (before - new), d_reset * before]) * gates * (1 - gates)
            d_state[side][:, :2 * hidden] += before.T @ d_gates
            d_state[side][:, 2 * hidden:] += (before * r).T @ d_new
            np.add.at(d_in[side], x[:, t], np.hstack([d_gates, d_new]))
            back = dh * z + d_gates @ u[:, :2 * hidden].T + d_reset * r
    return [*d_in, *d_state, *d_out, error.sum(axis=(0, 1))]


def windows(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of bytes (padded), their mask, and the text that each belongs to."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    counts = -(-sizes // width)
    owner = np.repeat(np.arange(len(blobs)), counts)
    flat, starts = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(sizes) - sizes
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * width
    at = first[:, None] + np.arange(width)
    mask = at < sizes[owner][:, None]
    spans = np.where(mask, flat[np.minimum(starts[owner][:, None] + at, max(len(flat) - 1, 0))], 0) if len(flat) else at
    return spans.astype(np.uint8), mask.astype(np.float32), owner


def probabilities(net: Network, blobs: list[bytes], width: int = SPAN) -> np.ndarray:
    """Mean of the positions' probabilities, per text; zeros for an empty text."""
    total = np.zeros((len(blobs), len(net.langs)))
    spans, mask, owner = windows(blobs, width)
    for k in range(0, len(owner), BLOCK):
        part = slice(k, k + BLOCK)
        found = np.einsum("tnc,nt->nc", forward(net, spans[part], mask[part]), mask[part])
        np.add.at(total, owner[part], found)
    return total / np.maximum(1, [len(b) for b in blobs])[:, None]


def position_labels(net: Network, blob: bytes, width: int = SPAN) -> list[str]:
    """The language at every byte of a text."""
    spans, mask, _ = windows([blob], width)
    best = forward(net, spans, mask).argmax(axis=2).T.reshape(-1)[:len(blob)] if blob else []
    return [net.langs[k] for k in best]


def fit(docs: DataFrame, held_out: Column | None = None, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
        span: int = SPAN, hidden: int = HIDDEN) -> Network | None:
    """A network from labelled rows outside ``held_out``; None without any.

    From each language come the ``sample_docs`` rows with the smallest id
    hashes, and from each of them ``sample_chars`` characters at a place given by
    the hash. Rows with null or empty text or null lang teach nothing.
    """
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (F.length("text") > 0))
    if held_out is not None:
        rows = rows.where(~held_out)
    key = F.xxhash64(F.col("doc_id").cast("string"))
    at = F.pmod(key, F.greatest(F.lit(1), F.length("text") - sample_chars)).cast("int") + 1
    rows = rows.select("lang", key.alias("_k"), F.substr("text", at, F.lit(sample_chars)).alias("text"))
    pick = F.row_number().over(Window.partitionBy("lang").orderBy("_k", "text"))
    found = rows.withColumn("_r", pick).where(F.col("_r") <= sample_docs).select("lang", "text").orderBy("lang", "_k").collect()
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return None
    blobs = [r["text"].encode() for r in found]
    spans, mask, owner = windows(blobs, span // 2)
    full = mask.all(axis=1)
    if full.any():
        spans, owner = spans[full], owner[full]
    labels = np.array([langs.index(r["lang"]) for r in found])[owner]
    # Each language counts the same: its windows are repeated up to the largest language's number.
    most = np.bincount(labels).max()
    even = np.concatenate([np.resize(np.flatnonzero(labels == k), most) for k in range(len(langs)) if (labels == k).any()])
    return train(spans[even], labels[even], langs, hidden)


def lang_id(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) per input row, from its whole text.

    ``docs`` needs doc_id and text; other columns are ignored whatever their
    names. Null text, text without a letter, and any text without a network
    give ``und`` with score 0. Repeated rows get the same answer each.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # bounded memory, however long the texts
                part = batch.slice(k, 256)
                texts = [t if net is not None and t and any(map(str.isalpha, t)) else "" for t in part.column("text").to_pylist()]
                if net is None:
                    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    p = probabilities(net, [t.encode() for t in texts])
                    score = np.clip(p.max(axis=1), 0.0, 1.0)
                    names = [net.langs[j] if t else UNKNOWN for t, j in zip(texts, p.argmax(axis=1), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
