"""Exact distinct counts from bitmaps of surrogate numbers.

A dimension's rows are numbered once; a set of them is then bits in words of
64, one row per word. Words merge by ``bit_or`` -- inside a task, across
partitions and across stored partial results -- in a hash aggregate of
fixed-width values, and the count of a set is the sum of ``bit_count``. Unlike
several ``countDistinct`` in one aggregate nothing expands the rows, and a
dense set takes a 64th of the rows a distinct would shuffle. (Spark's own
``bitmap_construct_agg`` takes 4 KB for every group however few its members,
and sorts.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Surrogate number of each id column that the fact carries.
NUMBERS = {"trip_id": "trip_no", "stop_id": "stop_no", "route_id": "route_no"}


def numbered(dim: DataFrame, key: list[str], name: str) -> DataFrame:
    """``dim`` with a number per row, unique in the table and consecutive inside a partition.

    Rows are sorted by ``key`` first, which must be unique: a repeated task
    gives its rows the same numbers. What is next to each other in ``key``
    order shares words.
    """
    return dim.sortWithinPartitions(*key).withColumn(name, F.monotonically_increasing_id())


def bit_words(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys..., word, bits): the set of ``number`` per key; a partial result that ``merge_words`` can join with others."""
    bit = F.expr(f"shiftleft(1L, cast({number} & 63 as int))")
    return (df.where(F.col(number).isNotNull()).groupBy(*keys, F.shiftright(number, 6).alias("word")).agg(F.bit_or(bit).alias("bits")))


def merge_words(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of sets from several tables, say of one day each."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def count_words(words: DataFrame, keys: list[str], name: str) -> DataFrame:
    return words.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("long").alias(name))


def distinct_count(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(keys..., name): distinct values of an id column, by its numbers where ``df`` carries them."""
    number = NUMBERS.get(column)
    if number in df.columns:
        return count_words(bit_words(df, keys, number), keys, name)
    return df.groupBy(*keys).agg(F.countDistinct(column).alias(name))
