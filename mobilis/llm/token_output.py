"""Token ids written as ORC, in document order, and read back.

Documents are range-partitioned and sorted by doc_id, encoded, and written with
ORC's integer run-length encoding, row indexes and a Bloom filter on doc_id. A
reader takes stripes in parallel and skips stripes and row groups by the
indexes and filters when it asks for single documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mobilis.llm.common import settings, shuffle_partitions, stored, text_batches
from mobilis.llm.token_cache import BYTE_LEVEL, encoder

END_ID = 2
#: Rows that ORC writers and readers hold at a time.
ROWS = 128
ORC_OPTIONS = {
    "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20),
    "orc.row.batch.size": str(ROWS),
}
_SCHEMA = "doc_id bigint, part int, ids array<int>"


def _encode(path: str, end_id: int):
    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        enc, end = encoder(path, BYTE_LEVEL), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # bounded output, however long the texts
                part = batch.slice(k, 256)
                found = [x + end for x in enc.encode(part.column("_t").to_pylist())]
                sizes = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), ids], names=["doc_id", "part", "ids"])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Writes (doc_id, part, ids) of every document to ORC files under ``path``.

    ``docs`` needs doc_id (an integer) and text; further columns are ignored
    whatever their names. Null text counts as empty: the document is its end
    id alone. Null ids sort first. Repeated rows are written as often as they
    occur. An empty table writes files without rows. The texts are sorted
    before they are encoded, so nothing is encoded twice.
    """
    parts = parts or shuffle_partitions(docs.sparkSession)
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"))
            .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("_t"))
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("_t"))
            .withColumn("part", F.spark_partition_id()))
    with text_batches(docs.sparkSession):
        rows.mapInArrow(_encode(tokenizer, end_id), _SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, part, ids); a list of ids is looked up by row indexes and Bloom filters."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _measured(batches: Iterator):
    """Of (doc_id, part, ids): n_tokens and the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(np.diff(ends).astype(np.int64)),
                                          pa.array(sums, pa.int64())], names=["doc_id", "part", "n_tokens", "ids_crc32"])


def token_index(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written documents: where each lies in the id stream.

    The ids are read once, a bounded number of documents at a time. Running
    sums are taken inside each written part; a part's own start comes from the
    totals of the parts, one row each. Copies of a row are in one part and get
    different starts.
    """
    # ORC readers hold whole batches of id lists, 4096 rows if not told otherwise.
    with text_batches(tokens.sparkSession), settings(tokens.sparkSession, spark__sql__orc__columnarReaderBatchSize=str(ROWS)):
        rows = stored(tokens.select("doc_id", "part", "ids").mapInArrow(_measured, "doc_id bigint, part int, n_tokens bigint, ids_crc32 bigint"),
                      "token-index")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32")
    before = F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    rows = rows.withColumn("_in", F.coalesce(before, F.lit(0)))
    sofar = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("_n").over(sofar), F.lit(0)).alias("_start"))
    return rows.join(parts, "part").select("doc_id", (F.col("_start") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")
