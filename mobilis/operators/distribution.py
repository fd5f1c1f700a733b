"""Data behind the charts: equal-width histograms, cumulative shares, box-plot statistics.

Histograms follow numpy's rules: ``bins`` equal bins over [min, max] of the
group (a single value v uses [v - 0.5, v + 0.5]); edges are ``lo + i * step``
with the last edge exactly ``max``; the last bin is closed, so the maximum
lands in it; a value is moved one bin down or up when float rounding put it
on the wrong side of an edge. Empty bins are listed with count 0.

The input is read twice (range per group, then counts): pass a stored or
persisted table, as the jobs do, rather than a long computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.operators.common import city_keys, join_keys


def _edge(i: Column, lo: Column, hi: Column, step: Column, bins: int) -> Column:
    return F.when(i >= bins, hi).otherwise(i * step + lo)


def histogram(df: DataFrame, value: str, bins: int, keys: list[str] | None = None) -> DataFrame:
    """(keys..., bin, bin_start, bin_end, count) with bins 0..bins-1 for every group."""
    keys = city_keys(df) if keys is None else list(keys)
    v = F.col(value).cast("double")
    data = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
    rng = data.groupBy(*keys).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    same = F.col("_mn") == F.col("_mx")
    rng = rng.select(*keys, F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                     F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    rng = rng.withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
    lo, hi, step = F.col("_lo"), F.col("_hi"), F.col("_step")

    x = join_keys(data, rng, keys)
    norm = F.lit(float(bins)) / (hi - lo)
    i0 = F.floor((F.col("_v") - lo) * norm).cast("int")
    i1 = F.when(i0 >= bins, F.lit(bins - 1)).otherwise(i0)
    x = x.withColumn("_i", i1)
    i = F.col("_i")
    x = x.withColumn("_i", F.when(F.col("_v") < _edge(i, lo, hi, step, bins), i - 1)
                          .when((F.col("_v") >= _edge(i + 1, lo, hi, step, bins)) & (i != bins - 1), i + 1)
                          .otherwise(i))
    counts = x.groupBy(*keys, F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("count"))

    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    b = F.col("bin")
    out = grid.join(counts, keys + ["bin"], "left")
    return out.select(*keys, "bin", _edge(b, lo, hi, step, bins).alias("bin_start"),
                      _edge(b + 1, lo, hi, step, bins).alias("bin_end"),
                      F.coalesce("count", F.lit(0)).alias("count"))


def cumulative_share(hist: DataFrame) -> DataFrame:
    """Running share of the histogram's total per group (a cumulative, density-normalised histogram)."""
    keys = city_keys(hist)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("bin")
    run = F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0))
    tot = F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hist.withColumn("cumulative_share", F.try_divide(run, tot))


def headway_minutes(headways: DataFrame, below: float = 60.0) -> DataFrame:
    """Headways in minutes, keeping those under ``below`` minutes."""
    m = F.col("headway_seconds") / F.lit(60.0)
    return headways.select(*city_keys(headways), m.alias("headway_min")).where(F.col("headway_min") < below)


def headway_histogram(headways: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(headway_minutes(headways), "headway_min", bins)


def headway_cdf(headways: DataFrame, bins: int = 50) -> DataFrame:
    return cumulative_share(headway_histogram(headways, bins))


def box_stats(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Quartiles (linear), IQR, whiskers (extreme values inside 1.5 IQR fences), outlier count.

    ``percentile`` is used directly: callers pass a column with a bounded
    number of distinct values per group (headway minutes: < 3600).
    """
    keys = city_keys(df) if keys is None else list(keys)
    v = F.col(value)
    q = df.groupBy(*keys).agg(F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.5).alias("median"),
                              F.percentile(v, 0.75).alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumns({"_lo": F.col("q1") - 1.5 * F.col("iqr"), "_hi": F.col("q3") + 1.5 * F.col("iqr")})
    j = join_keys(df.select(*keys, v.alias("_v")), q, keys)
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    w = j.groupBy(*keys).agg(F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
                             F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
                             F.count_if(~inside).alias("outliers"))
    return join_keys(q.drop("_lo", "_hi"), w, keys)


def headway_box(headways: DataFrame) -> DataFrame:
    return box_stats(headway_minutes(headways), "headway_min")


def trips_histogram(route_stats: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(route_stats, "num_trips", bins)


def stops_histogram(route_stats: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(route_stats, "num_stops", bins)


def routes_per_stop_histogram(spatial_stats: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(spatial_stats, "num_routes", bins)
