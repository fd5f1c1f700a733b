"""Stored tables and result sinks.

A store is a folder of Parquet tables, one folder per table, partitioned by
``city``; replacing one city's rows overwrites only its partition (dynamic
partition overwrite), so cities load independently and reads prune to
the wanted city.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mobilis import constants as K
from mobilis.sources import feeds


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("city",)) -> None:
    """Replace the table's content for the partitions present in ``df``."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    cols = [c for c in partition_by if c in df.columns]
    (w.partitionBy(*cols) if cols else w).parquet(path)


def read_table(spark: SparkSession, store: str, table: str, city: str | None = None) -> DataFrame | None:
    """A stored table, pruned to one city when given; None when the table does not exist."""
    path = f"{store.rstrip('/')}/{table}"
    if not feeds.exists(spark, path):
        return None
    df = spark.read.parquet(path)
    return df.where(F.col("city") == city) if city is not None and "city" in df.columns else df


def essential_gate(spark: SparkSession, store: str, city: str, tables: list[str] | None = None) -> bool:
    """True when every essential table exists and holds at least one row for the city."""
    for t in tables or K.ESSENTIAL_TABLES:
        df = read_table(spark, store, t, city)
        if df is None or df.isEmpty():
            return False
    return True


def import_city(spark: SparkSession, base_dir: str, city: str, store: str) -> DataFrame | None:
    """Load a city's feed files into the store after the checks.

    Gate on completeness (no required file missing or empty); then for each
    ``.txt`` file: read (typed by name), normalise names, check structure,
    write the city's partition. Returns one row per file: table, rows,
    loaded, and the columns left as text because a value did not cast -- or
    None when the gate fails. Rows were counted by the one read.
    """
    gate = feeds.feed_gate(feeds.feed_completeness(spark, base_dir, [city])).first()
    if gate is None or not gate.passed:
        return None
    out = []
    for table in feeds.city_files(spark, base_dir, city):
        feed = feeds.store_feed(spark, f"{base_dir.rstrip('/')}/{city}/{table}.txt", table)
        loaded = feed.rows > 0 and feeds.has_required(feed.df, table)
        if loaded:
            write_table(feed.df.withColumn("city", F.lit(city)), f"{store.rstrip('/')}/{table}")
        as_text = [c for c in feed.df.columns if feed.rejects.get(c)] if loaded else []
        out.append((table, feed.rows if loaded else 0, loaded, ",".join(as_text)))
    return spark.createDataFrame(out, "table_name string, rows bigint, loaded boolean, text_columns string")


def written_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a written table with their ``place`` (from 1) over all files, in order of the files' numbers.

    A file's rows count from what the files before it hold, one row a file.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # names begin with padded numbers
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn("place", F.col("_start") + F.col("_row") + 1).drop("_file", "_row", "_start")


def write_results(results: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> None:
    """Write each result table in full."""
    for name, df in results.items():
        if df is None:
            continue
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(f"{out_dir.rstrip('/')}/{name}")
        else:
            w.parquet(f"{out_dir.rstrip('/')}/{name}")


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table and, as ``total``, of all together (one aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
             for n, df in tables.items()]
    each = reduce(DataFrame.unionByName, parts)
    return each.unionByName(each.agg(F.sum("rows").alias("rows")).select(F.lit("total").alias("table_name"), "rows"))


def store_sizes(spark: SparkSession, store: str) -> DataFrame:
    """Bytes and MB per stored table, from file lengths (no data read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(store).select("path", "length")
    rel = F.regexp_extract("path", rf"{re.escape(store.rstrip('/'))}/([^/]+)/", 1)
    return files.where(F.col("path").endswith(".parquet")).groupBy(rel.alias("table_name")).agg(
        F.sum("length").alias("size_bytes")).withColumn("size_mb", F.round(F.col("size_bytes") / 1048576.0, 2))


def table_sample(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows by ``order`` (a sample by definition)."""
    return df.orderBy(*order).limit(n)
