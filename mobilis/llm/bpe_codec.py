"""Byte-level BPE encoding with overlapping chunks, and decoding.

Texts are cut into chunks that overlap. Every chunk is pre-tokenised from its
own start, in parallel. The pre-tokeniser scans left to right and never looks
back, so as soon as a chunk shares a boundary with the chunk before it, both
agree from there on: that boundary is the cut between them. Each chunk then
encodes its pre-tokens between two cuts, and a document's ids are the ids of its
chunks in order. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 16
OVERLAP = 1 << 10
LIMIT = 400_000

_CODECS: dict[tuple, Codec] = {}


class Codec:
    """One vocabulary in one Python worker, with the ids of the pre-tokens seen so far."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = {i: b for b, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    def ids(self, pieces: list[str]) -> bytes:
        """Ids of the pre-tokens, as 32-bit integers of this machine's (little-endian) order."""
        known = self.known
        if len(known) > LIMIT:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = array("i", self.encoding.encode_ordinary(piece)).tobytes()
        return b"".join([known[p] for p in pieces])

    def between(self, text: str, start: int, end: int) -> list[str]:
        """The pre-tokens that start at ``start`` or later and before ``end``."""
        if start == 0 and end >= len(text):
            return self.pattern.findall(text)
        found = []
        for m in self.pattern.finditer(text, start):
            if m.start() >= end:
                break
            found.append(m.group())
        return found

    def boundaries(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _lists(blobs: list[bytes]):
    import numpy as np
    import pyarrow as pa

    sizes = np.cumsum([0, *(len(x) // 4 for x in blobs)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def _encode_pieces(path: str, pattern: str, keys: list[str]):
    """keys, ids from keys, _t (a chunk), _from and _to (the cuts inside it)."""
    def run(batches: Iterator):
        import pyarrow as pa

        c = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # bounded output, however long the texts
                part = batch.slice(k, 256)
                texts, a, b = (part.column(x).to_pylist() for x in ("_t", "_from", "_to"))
                blobs = [c.ids(c.between(*row)) for row in zip(texts, a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in keys), _lists(blobs)], names=[*keys, "ids"])
    return run


def _edges(path: str, pattern: str, chunk: int, overlap: int):
    """Adds the boundaries in a chunk's first ``overlap`` characters (head) and past its own part (tail), as text positions."""
    def run(batches: Iterator):
        import pyarrow as pa

        c = codec(path, pattern)
        for batch in batches:
            heads, tails = [], []
            for k, text, last in zip(*(batch.column(x).to_pylist() for x in ("k", "_t", "_last")), strict=True):
                at = c.boundaries(text)
                # The last tokens may be due to the chunk's end; their starts do not count.
                sure = at if last else at[:-2]
                heads.append([k * chunk + x for x in sure if x < overlap])
                tails.append([k * chunk + x for x in sure if x >= chunk])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, kind), pa.array(tails, kind)],
                                             names=[*batch.schema.names, "_head", "_tail"])
    return run


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) per input row: the ids of its whole text, each pre-token encoded separately.

    ``docs`` needs doc_id and text; further columns are ignored whatever their
    names. Null text counts as empty and has no ids. Repeated rows come back
    as often as they occur. A text no longer than one chunk has nothing to
    stitch and is encoded where it is read. Where two chunks share no boundary
    in their overlap (one pre-token longer than the overlap), the document's
    text is encoded in one piece instead.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).withColumn("_n", F.length("_t"))
    kinds = dict(rows.dtypes) | {"_doc": "string", "_copies": "bigint", "k": "int"}

    def schema(keys: list[str]) -> str:
        return ", ".join(f"{x} {kinds[x]}" for x in keys) + ", ids array<int>"

    def whole(df: DataFrame, keys: list[str]) -> DataFrame:
        cuts = df.select(*keys, "_t", F.lit(0).alias("_from"), F.length("_t").alias("_to"))
        return cuts.mapInArrow(_encode_pieces(path, pattern, keys), schema(keys))

    short = whole(rows.where(F.col("_n") <= chunk), ["doc_id"])

    long = rows.where(F.col("_n") > chunk).withColumn("_doc", F.sha2("_t", 256))
    # Copies of a row are one document with a count, so that a chunk is known by (doc_id, _doc, k).
    long = long.groupBy("doc_id", "_doc").agg(F.count(F.lit(1)).alias("_copies"), F.first("_t").alias("_t"), F.first("_n").alias("_n"))
    chunks = (long.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk).cast("int"))))
              .withColumn("_last", (F.col("k") + 1) * chunk >= F.col("_n"))
              .withColumn("_t", F.expr(f"substring(_t, k * {chunk} + 1, {chunk + overlap})"))
              .drop("_n").repartition("doc_id", "_doc", "k"))
    found = T.ArrayType(T.LongType())
    edges = chunks.mapInArrow(_edges(path, pattern, chunk, overlap),
                              T.StructType([*chunks.schema.fields, T.StructField("_head", found), T.StructField("_tail", found)]))
    doc = Window.partitionBy("doc_id", "_doc")
    order = doc.orderBy("k")
    shared = F.array_min(F.array_intersect("_head", F.lag("_tail").over(order)))
    cut = edges.withColumn("_cut", F.when(F.col("k") == 0, F.lit(0)).otherwise(shared))
    cut = (cut.withColumn("_next", F.lead("_cut").over(order)).withColumn("_lost", F.max(F.col("_cut").isNull()).over(doc)))
    stitched = (cut.where(~F.col("_lost"))
                .withColumn("_from", (F.col("_cut") - F.col("k") * chunk).cast("int"))
                .withColumn("_to", F.coalesce(F.col("_next") - F.col("k") * chunk, F.length("_t")).cast("int"))
                .select("doc_id", "_doc", "_copies", "k", "_t", "_from", "_to"))
    keys = ["doc_id", "_doc", "_copies", "k"]
    parts = stitched.mapInArrow(_encode_pieces(path, pattern, keys), schema(keys))
    joined = (parts.groupBy("doc_id", "_doc", "_copies").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("_p"))
              .select("doc_id", "_copies", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids")))
    lost = cut.where(F.col("_lost") & (F.col("k") == 0)).select(F.col("doc_id").alias("_id"), F.col("_doc").alias("_key"))
    unstitched = whole(long.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_doc") == F.col("_key")), "left_semi"),
                       ["doc_id", "_copies"]).select("doc_id", "_copies", "ids")
    many = joined.unionByName(unstitched).select("doc_id", "ids", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_"))
    return short.unionByName(many.select("doc_id", "ids"))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary): the raw bytes of ``ids``, concatenated. Null ids give null."""
    def run(batches: Iterator):
        import pyarrow as pa

        raw = codec(path, pattern).raw.__getitem__
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column("ids")
                ends, known = lists.offsets.to_pylist(), lists.is_valid().to_pylist()
                first = ends[0]
                ids = lists.values.slice(first, ends[-1] - first).to_numpy(zero_copy_only=False).tolist()
                out = [b"".join(map(raw, ids[a - first:b - first])) if ok else None
                       for a, b, ok in zip(ends[:-1], ends[1:], known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])
    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())]))
