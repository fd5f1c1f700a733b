"""Intermediate tables that lie in buckets, so that joins and groups of one bucket need no shuffle.

A bucketed table has a column ``b`` that holds the label of its bucket. Tables
with equally many buckets join on (b, ...) where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.session import scratch_path

_CONF = {
    # Both sides of a join on (b, ...) lie by b alone, which is enough.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


@contextmanager
def bucket_joins(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside use the buckets of tables for joins on (b, ...)."""
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def labels(spark: SparkSession, n: int) -> list[int]:
    """The smallest label of each of ``n`` buckets: Spark puts label i into bucket i."""
    found, size = {}, 1
    while len(found) < n:
        size = 4 * max(size, n)
        ids = spark.range(size).select(F.col("id").cast("int").alias("label"))
        rows = ids.groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("bucket")).agg(F.min("label").alias("label")).collect()  # n rows at most
        found = {r.bucket: r.label for r in rows}
    return [found[i] for i in range(n)]


def label(of: Column, known: list[int]) -> Column:
    """The bucket label of a row, by a hash of ``of``."""
    place = F.pmod(F.xxhash64(of), F.lit(len(known))).cast("int")
    return F.get(F.array(*[F.lit(x) for x in known]), place) if len(known) > 1 else F.lit(known[0])


class Buckets:
    """Bucketed tables in the shared folder; ``drop`` removes the ones no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str, n: int) -> DataFrame:
        """``df``, which has the column b, written in n buckets of one file each and read back."""
        return self.store_here(df.repartition(n, "b"), name, n)

    def store_here(self, df: DataFrame, name: str, n: int) -> DataFrame:
        """As ``store``, for rows that lie in their buckets already."""
        path = scratch_path(self.spark, name)
        table = path.rsplit("/", 1)[1].replace("-", "_")
        df.write.bucketBy(n, "b").option("path", path).format("parquet").saveAsTable(table)
        self.paths[name] = (table, path)
        return self.spark.read.table(table)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as it lies, without buckets, and read back."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = (None, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        table, path = self.paths.pop(name)
        if table is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

    def drop_all(self) -> None:
        for name in list(self.paths):
            self.drop(name)
