"""Exact linear-interpolated quantiles of columns in two scans, without shuffling or sorting their values.

1. One aggregate a table gives the plain statistics of every column and a KLL
   sketch of it, whose quantiles a little below and above each wanted
   probability are bounds that hold the wanted ranks between them: one row a
   column.
2. One aggregate over all columns counts the values below, between and above
   all bounds: a value outside them only adds to the count of its zone, a
   value inside is kept as (value, count).
3. Running counts over what is kept find the values at the ranks floor(h) and
   ceil(h), h = (n - 1) * p, which are interpolated.

A sketch may err more than expected; then a wanted rank lies in no kept zone
and both scans are repeated with bounds further apart, so results are exact. They equal pandas ``quantile`` / DuckDB ``quantile_cont``. Values keep
their type up to the interpolation, so long ids are not rounded to doubles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mobilis.session import scratch_path

#: Size of a sketch. Its rank error is below ``_error`` of the rows in 99 of 100 cases.
SKETCH = 32768
#: Distance of the bounds from the wanted probability, in rank errors, and in rows at least.
MARGIN, MARGIN_ROWS = 2.0, 2
_LONGS = (-(1 << 63), (1 << 63) - 1)


def _error() -> float:
    return 2.296 / SKETCH ** 0.9021


def usable(df: DataFrame, column: str) -> Column:
    """The column with NaN as null."""
    kind = df.schema[column].dataType
    c = F.col(column)
    return F.nanvl(c, F.lit(None).cast(kind)) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


@dataclass
class Scanned:
    """What the two scans found out about the columns that have a value.

    ``columns`` names them (table, column); elsewhere they go by their place
    in that list. ``zones`` are the bounds of a column's kept zones, in order
    and disjoint: zone 2i lies before the i-th one, zone 2i + 1 is it.
    ``counts`` has rows (col, zone, l, d, c): the values inside kept zones
    with their counts (longs in l, others in d), and one row for each other
    zone. ``totals`` are the rows of each (col, zone).
    """

    columns: list[tuple[str, str]]
    stats: list
    zones: list[list[tuple]]
    counts: DataFrame
    totals: dict[tuple[int, int], int]

    def below(self, col: int, zone: int) -> int:
        return sum(self.totals.get((col, z), 0) for z in range(zone))

    def zone_of(self, col: int, rank: int) -> int | None:
        """The kept zone that holds a rank, if one does."""
        for zone in range(1, 2 * len(self.zones[col]), 2):
            first = self.below(col, zone)
            if first <= rank < first + self.totals.get((col, zone), 0):
                return zone
        return None


def ranks(n: int, p: float) -> tuple[int, int, float]:
    """Ranks of the two values around the quantile, and the share of the second."""
    h = (n - 1) * p
    return max(math.floor(h), 0), min(math.ceil(h), n - 1), h - math.floor(h)


def _values(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, bool]]:
    """The columns as longs or doubles, and which are longs."""
    whole = {c: isinstance(df.schema[c].dataType, T.IntegralType) for c in columns}
    return df.select(*[usable(df, c).cast("bigint" if whole[c] else "double").alias(c) for c in columns]), whole


def _sketched(df: DataFrame, table: str, columns: list[str], probs: list[float], step: float) -> DataFrame:
    """One row a column: plain statistics and, per probability, bounds from its sketch."""
    values, whole = _values(df, columns)
    aggregates, rows = [], []
    for c in columns:
        kind = "bigint" if whole[c] else "double"
        sketch = getattr(F, f"kll_sketch_agg_{kind}")(c, F.lit(SKETCH))
        aggregates.append(F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                                   F.min(c).alias("least"), F.max(c).alias("most"), sketch.alias("sketch")).alias(c))
        x = F.col(f"`{c}`")
        at = getattr(F, f"kll_sketch_get_quantile_{kind}")
        bounds = [F.when(x["n"] > 0, at(x["sketch"], F.lit(min(max(p + side * step, 0.0), 1.0)))) for p in probs for side in (-1, 1)]
        rows.append(F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(whole[c]).alias("whole"), x["n"].alias("n"),
                             x["mean"].alias("mean"), x["std"].alias("std"),
                             *[y for name, v in [("least", x["least"]), ("most", x["most"])] for y in _typed(v, whole[c], name)],
                             *[y for k, b in enumerate(bounds) for y in _typed(b, whole[c], f"b{k}_")]))
    return values.agg(*aggregates).select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("n > 0")


def _typed(value: Column, whole: bool, name: str) -> list[Column]:
    none = F.lit(None)
    return [(value if whole else none).cast("bigint").alias(f"{name}l"), (none if whole else value).cast("double").alias(f"{name}d")]


def _zones(row, probs: list[float], fences: float | None, step: float) -> list[tuple]:
    """Disjoint bounds that hold the wanted ranks and, with ``fences``, the fences; of a few rows all values are kept."""
    kind, (least, most) = ("l", _LONGS) if row.whole else ("d", (-math.inf, math.inf))
    if row.n * step < MARGIN_ROWS:
        return [(least, most)]
    bounds = []
    for k, p in enumerate(probs):
        low = row[f"b{2 * k}_{kind}"] if p - step > 0 else least
        bounds.append((low, row[f"b{2 * k + 1}_{kind}"] if p + step < 1 else most))
    if fences is not None:
        (a1, b1), (a3, b3) = bounds[probs.index(0.25)], bounds[probs.index(0.75)]
        for low, high in (((1 + fences) * a1 - fences * b3, (1 + fences) * b1 - fences * a3),
                          ((1 + fences) * a3 - fences * b1, (1 + fences) * b3 - fences * a1)):
            low, high = low - abs(low) * 1e-12, high + abs(high) * 1e-12  # roundings of the exact fence
            if math.isnan(low) or math.isnan(high):
                low, high = -math.inf, math.inf
            if row.whole:
                low = least if low <= least else math.floor(low) - 1
                high = most if high >= most else math.ceil(high) + 1
            bounds.append((max(low, least), min(high, most)))
    merged: list[tuple] = []
    for low, high in sorted(bounds):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def _entries(df: DataFrame, columns: list[tuple[int, str]], zones: list[list[tuple]]) -> DataFrame:
    """(col, zone, l, d) of every value; l and d are null outside kept zones."""
    values, whole = _values(df, [c for _, c in columns])
    entries = []
    for col, c in columns:
        kind = "bigint" if whole[c] else "double"
        zone, kept = F.when(F.col(c).isNull(), F.lit(None).cast("int")), F.lit(False)
        for i, (low, high) in enumerate(zones[col]):
            low, high = F.lit(low).cast(kind), F.lit(high).cast(kind)
            zone = zone.when(F.col(c) < low, F.lit(2 * i)).when(F.col(c) <= high, F.lit(2 * i + 1))
            kept = kept | F.col(c).between(low, high)
        entries.append(F.struct(F.lit(col).alias("col"), zone.otherwise(F.lit(2 * len(zones[col]))).alias("zone"),
                                *[x for x, n in zip(_typed(F.when(kept, F.col(c)), whole[c], ""), "ld", strict=True)]))
    return values.select(F.explode(F.array(*entries)).alias("x")).select("x.*").where(F.col("zone").isNotNull())


def scan(tables: dict[str, DataFrame], columns: dict[str, list[str]], probs: list[float], fences: float | None = None) -> Scanned | None:
    """The two scans of several tables at once; None when no column has a value.

    ``fences`` keeps the values near Q1 - fences IQR and Q3 + fences IQR, too;
    ``probs`` must then hold both quartiles.
    """
    named = {t: df for t, df in tables.items() if columns[t]}
    margin = MARGIN
    while named:
        step = margin * _error()
        first = reduce(DataFrame.unionByName, [_sketched(df, t, columns[t], probs, step) for t, df in named.items()])
        stats = first.collect()  # one row a column
        if not stats:
            return None
        zones = [_zones(r, probs, fences, step) for r in stats]
        of = {t: [(i, r.column_name) for i, r in enumerate(stats) if r.table_name == t] for t in named}
        counts = (reduce(DataFrame.unionByName, [_entries(df, of[t], zones) for t, df in named.items() if of[t]])
                  .groupBy("col", "zone", "l", "d").agg(F.count(F.lit(1)).alias("c")))
        spark = counts.sparkSession
        path = scratch_path(spark, "quantile-counts")
        counts.write.parquet(path)
        counts = spark.read.schema(counts.schema).parquet(path)
        totals = {(r.col, r.zone): r.n for r in counts.groupBy("col", "zone").agg(F.sum("c").alias("n")).collect()}
        found = Scanned([(r.table_name, r.column_name) for r in stats], stats, zones, counts, totals)
        if all(found.zone_of(i, r) is not None for i, x in enumerate(stats) for p in probs for r in ranks(x.n, p)[:2]):
            return found
        margin *= 4
    return None


def quantiles(found: Scanned, probs: list[float]) -> DataFrame:
    """(table_name, column_name, p, quantile) for each column and each probability."""
    wanted = []
    for col, (table, column) in enumerate(found.columns):
        for p in probs:
            low, high, share = ranks(found.stats[col].n, p)
            for side, rank in enumerate((low, high)):
                zone = found.zone_of(col, rank)
                wanted.append((col, zone, table, column, float(p), rank - found.below(col, zone), side, float(share)))
    asked = found.counts.sparkSession.createDataFrame(
        wanted, "col int, zone int, table_name string, column_name string, p double, rank bigint, side int, share double")
    upto = F.sum("c").over(Window.partitionBy("col", "zone").orderBy("l", "d").rowsBetween(Window.unboundedPreceding, 0))
    at = (found.counts.where(F.col("zone") % 2 == 1).withColumn("end", upto)
          .join(F.broadcast(asked), ["col", "zone"])  # two rows a column and probability
          .where((F.col("rank") >= F.col("end") - F.col("c")) & (F.col("rank") < F.col("end"))))

    def value(side: int, x: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(x)))

    picked = at.groupBy("table_name", "column_name", "p").agg(value(0, "l").alias("l0"), value(1, "l").alias("l1"), value(0, "d").alias("d0"),
                                                              value(1, "d").alias("d1"), F.max("share").alias("share"))
    low = F.coalesce(F.col("l0").cast("double"), F.col("d0"))
    span = F.coalesce((F.col("l1") - F.col("l0")).cast("double"), F.col("d1") - F.col("d0"))
    same = (F.col("share") == 0) | (F.col("d0").isNotNull() & (F.col("d0") == F.col("d1")))  # infinite values, say
    return picked.select("table_name", "column_name", "p", F.when(same, low).otherwise(low + F.col("share") * span).alias("quantile"))


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """(column_name, p, quantile) for each column with a value and each probability."""
    found = scan({"": df}, {"": columns}, probs)
    if found is None:
        return df.sparkSession.createDataFrame([], "column_name string, p double, quantile double")
    return quantiles(found, probs).drop("table_name")


def outliers(found: Scanned, quartiles: DataFrame, fences: float) -> DataFrame:
    """(table_name, column_name, outliers): values outside Q1 - fences IQR .. Q3 + fences IQR.

    From a scan that kept the values near the fences; ``quartiles`` has
    table_name, column_name, q1 and q3. A value on a fence is none.
    """
    # A zone that was not kept lies on one side of each fence: the bounds next to it tell which.
    edges = [(col, zone, *found.columns[col],
              float(zones[zone // 2][0]) if zone // 2 < len(zones) else math.inf, float(zones[zone // 2 - 1][1]) if zone > 1 else -math.inf)
             for col, zones in enumerate(found.zones) for zone in range(2 * len(zones) + 1)]
    sides = found.counts.sparkSession.createDataFrame(
        edges, "col int, zone int, table_name string, column_name string, next double, previous double")
    spread = F.col("q3") - F.col("q1")
    limits = quartiles.select("table_name", "column_name", (F.col("q1") - fences * spread).alias("lo"), (F.col("q3") + fences * spread).alias("hi"))
    # A few rows a column on this side.
    rows = found.counts.join(F.broadcast(sides.join(limits, ["table_name", "column_name"])), ["col", "zone"])
    value = F.coalesce(F.col("l").cast("double"), F.col("d"))
    outside = F.when(F.col("zone") % 2 == 1, (value < F.col("lo")) | (value > F.col("hi"))).otherwise(
        (F.col("next") <= F.col("lo")) | (F.col("previous") >= F.col("hi")))
    return rows.groupBy("table_name", "column_name").agg(F.sum(F.when(outside, F.col("c")).otherwise(0)).alias("outliers"))
