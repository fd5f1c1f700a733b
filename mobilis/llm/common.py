"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.session import scratch_path

#: Characters that separate words, as the inside of a regular-expression class.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Cuts the lineage: whatever reads the result starts from files that every
    executor can reach, so a lost executor costs no recomputation upstream.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a Python worker gets at a time where rows are whole texts.
TEXTS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Jobs run inside see these settings (``__`` stands for a dot)."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def text_batches(spark: SparkSession):
    """Jobs run inside hand Python workers at most ``TEXTS`` rows at a time, which bounds their memory."""
    now = int(spark.conf.get(_BATCH))
    return settings(spark, **{_BATCH: str(min(TEXTS, now) if now > 0 else TEXTS)})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once per row.

    Inside a lambda an outer expression would be evaluated for every element;
    bound to a lambda variable it is a plain value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space, as an array."""
    return F.array_remove(F.split(text, f"[{BLANKS}]+"), "")
