"""Helpers shared by operators: tenant keys, deterministic dedup, joins on tenant keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TENANT = "city"


def city_keys(df: DataFrame) -> list[str]:
    """The tenant key, when the frame carries one."""
    return [TENANT] if TENANT in df.columns else []


def one_row_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop null keys, keep one row per key: the smallest by the other columns.

    Deterministic form of ``dropDuplicates``. An aggregate (not a window) so a
    hot key is collapsed map-side before the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    df = df.where(cond) if cond is not None else df
    if not others:
        return df.dropDuplicates(keys)
    return (df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r"))
              .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])
              .select(*df.columns))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the tenant keys; without keys ``right`` is a single row that goes to every row of ``left``."""
    if keys:
        return left.join(right, keys, how)
    if how not in ("inner", "left"):
        raise ValueError("without keys only a single row can be joined")
    return left.crossJoin(F.broadcast(right.limit(1)))


def side_by_side(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames with one row per key merged into one row per key (the meaning of full outer joins; null keys are equal).

    The frames have disjoint value columns, so union them by name and keep,
    per key and column, the single non-null value: one shuffle instead of a
    join chain. ``max`` picks it deterministically.
    """
    cols = []
    for f in frames:
        cols += [c for c in f.columns if c not in keys and c not in cols]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])
