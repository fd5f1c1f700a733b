"""Per-city summaries of the transit metric tables, gaps and the assessment.

Every summary is one ``groupBy(city)`` over an already aggregated metric
table; without a ``city`` column it is a single global row. Percentiles are
linear (pandas' default quantile). The inputs of ``percentile`` here have a
bounded number of distinct values per city (route-level counts, or headway
seconds below 3600), which bounds the aggregation buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilis import constants as K
from mobilis.operators.common import city_keys, join_keys, side_by_side


def route_summary(route_stats: DataFrame) -> DataFrame:
    """Count, mean/median trips, mean stops, total events, busiest route, frequency buckets.

    Busiest route: most trips; the smallest route_id wins a tie.
    """
    keys = city_keys(route_stats)
    t = F.col("num_trips")
    return route_stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_routes"),
        F.avg(t).alias("avg_trips_per_route"),
        F.percentile(t, 0.5).alias("median_trips_per_route"),
        F.avg("num_stops").alias("avg_stops_per_route"),
        F.sum("total_stop_events").alias("total_stop_events"),
        F.min_by("route_id", F.struct((-t).alias("t"), F.col("route_id"))).alias("busiest_route_id"),
        F.max(t).alias("busiest_route_trips"),
        F.count_if(t > K.HIGH_FREQUENCY_TRIPS).alias("high_frequency"),
        F.count_if((t >= K.LOW_FREQUENCY_TRIPS) & (t <= K.HIGH_FREQUENCY_TRIPS)).alias("medium_frequency"),
        F.count_if(t < K.LOW_FREQUENCY_TRIPS).alias("low_frequency"),
    )


def headway_summary(headways: DataFrame) -> DataFrame:
    """Headways in minutes: mean, median, sample std, min, max, p95, p05, count, % <= 15, % <= 5.

    Percentages are null when there are no headways (no division error).
    """
    keys = city_keys(headways)
    m = F.col("headway_seconds") / F.lit(60.0)
    n = F.count(F.lit(1))
    return headways.groupBy(*keys).agg(
        F.avg(m).alias("avg_headway_min"),
        F.percentile(m, 0.5).alias("median_headway_min"),
        F.stddev_samp(m).alias("std_headway_min"),
        F.min(m).alias("min_headway_min"),
        F.max(m).alias("max_headway_min"),
        F.percentile(m, 0.95).alias("p95_headway_min"),
        F.percentile(m, 0.05).alias("p05_headway_min"),
        n.alias("total_headways_analyzed"),
        (F.try_divide(F.count_if(m <= K.ON_TIME_HEADWAY_MIN), n) * 100).alias("on_time_percentage"),
        (F.try_divide(F.count_if(m <= K.HIGH_FREQ_HEADWAY_MIN), n) * 100).alias("high_frequency_percentage"),
    )


def hourly_profile(hourly_service: DataFrame) -> DataFrame:
    """Trips and stop events summed by arrival hour (per city)."""
    keys = city_keys(hourly_service)
    return hourly_service.groupBy(*keys, "arrival_hour").agg(
        F.sum("hourly_trips").alias("hourly_trips"),
        F.sum("hourly_stop_events").alias("hourly_stop_events"),
    )


def _gap_hours(hours_with_trips: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: ~F.array_contains(hours_with_trips, h))


def service_profile(hourly_service: DataFrame) -> DataFrame:
    """Peak hour and its trips, off-peak hour, hours served, (hour, trips) list, gap hours.

    Peak/off-peak ties go to the lowest hour. Gap hours are 0-23 with no
    service or zero trips; hours >= 24 are counted as served hours but are
    not folded back into the day.
    """
    keys = city_keys(hourly_service)
    h = hourly_profile(hourly_service)
    trips, hour = F.col("hourly_trips"), F.col("arrival_hour")
    return h.groupBy(*keys).agg(
        F.min_by(hour, F.struct((-trips).alias("t"), hour)).alias("peak_hour"),
        F.max(trips).alias("peak_hour_trips"),
        F.min_by(hour, F.struct(trips, hour)).alias("off_peak_hour"),
        F.countDistinct(hour).alias("total_service_hours"),
        F.sort_array(F.collect_list(F.struct(hour.alias("arrival_hour"), trips.alias("hourly_trips"))))
         .alias("daily_trip_pattern"),
        F.collect_set(F.when(trips > 0, hour)).alias("_served"),
    ).withColumn("service_gaps", _gap_hours(F.col("_served"))).drop("_served")


def service_gaps(hourly_service: DataFrame) -> DataFrame:
    """One row per (city, hour 0-23) with no service or zero trips."""
    keys = city_keys(hourly_service)
    h = hourly_profile(hourly_service)
    served = h.where(F.col("hourly_trips") > 0).select(*keys, F.col("arrival_hour").alias("hour"))
    base = h.select(*keys).distinct() if keys else h.sparkSession.range(1).select()
    day = base.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return day.join(served, keys + ["hour"], "left_anti")


def stop_summary(spatial_stats: DataFrame) -> DataFrame:
    """Stops, mean and max routes per stop, hubs (>= 5 routes), lat and lon ranges."""
    keys = city_keys(spatial_stats)
    r = F.col("num_routes")
    return spatial_stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_stops_analyzed"),
        F.avg(r).alias("avg_routes_per_stop"),
        F.max(r).alias("max_routes_per_stop"),
        F.count_if(r >= K.HUB_MIN_ROUTES).alias("major_hubs"),
        F.min("avg_lat").alias("lat_min"), F.max("avg_lat").alias("lat_max"),
        F.min("avg_lon").alias("lon_min"), F.max("avg_lon").alias("lon_max"),
    )


def _assessment() -> dict[str, Column]:
    """Assessment columns of a row with total_routes, avg_trips_per_route, avg_headway_min, total_stop_events."""
    has_routes = F.col("total_routes").isNotNull()
    busy = F.coalesce(F.col("avg_trips_per_route") > K.STRENGTH_TRIPS_PER_ROUTE, F.lit(False))
    steady = F.coalesce(F.col("avg_headway_min") < K.STRENGTH_HEADWAY_MIN, F.lit(False))
    strengths = F.array(F.when(has_routes & busy, F.lit(K.TEXT_HIGH_FREQUENCY)),
                        F.when(steady, F.lit(K.TEXT_GOOD_HEADWAY)))
    improvements = F.array(F.when(has_routes & ~busy, F.lit(K.TEXT_RAISE_FREQUENCY)),
                           F.when(~steady, F.lit(K.TEXT_IMPROVE_HEADWAY)))
    return {"overall_score": F.lit(0), "key_strengths": F.array_compact(strengths),
            "improvement_areas": F.array_compact(improvements), "total_trips_estimate": F.col("total_stop_events")}


def city_assessment(route_sum: DataFrame, headway_sum: DataFrame) -> DataFrame:
    """Rule-based strengths and improvement areas per city.

    Mean trips per route > 50 is a strength, else an improvement; mean
    headway < 10 min is a strength, else (also when null) an improvement.
    total_trips_estimate is the total of stop events; overall_score is 0.
    """
    keys = city_keys(route_sum)
    r = route_sum.select(*keys, "total_routes", "avg_trips_per_route", "total_stop_events")
    j = side_by_side([r, headway_sum.select(*keys, "avg_headway_min")], keys)
    return j.select(*keys, *[c.alias(n) for n, c in _assessment().items() if n != "total_trips_estimate"], "total_routes",
                    F.col("total_stop_events").alias("total_trips_estimate"))


def city_analysis(route_stats: DataFrame, headways: DataFrame, hourly_service: DataFrame,
                  spatial_stats: DataFrame) -> DataFrame:
    """One row per city: route, headway, service and stop summaries plus the assessment.

    The summaries are merged first; the assessment is read off the merged row,
    so each metric is computed once.
    """
    parts = [route_summary(route_stats), headway_summary(headways), service_profile(hourly_service), stop_summary(spatial_stats)]
    return side_by_side(parts, city_keys(route_stats)).withColumns(_assessment())


def transit_city_comparison(route_stats: DataFrame, headways: DataFrame, spatial_stats: DataFrame,
                            hourly_service: DataFrame) -> DataFrame:
    """Per city: routes, mean headway in minutes, stops, max route-hour trips; absent = 0."""
    keys = city_keys(route_stats)
    parts = [
        route_stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("routes")),
        headways.groupBy(*keys).agg((F.avg("headway_seconds") / 60).alias("avg_headway_min")),
        spatial_stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("stops")),
        hourly_service.groupBy(*keys).agg(F.max("hourly_trips").alias("peak_hour_trips")),
    ]
    j = side_by_side(parts, keys)
    return j.select(*keys, F.coalesce("routes", F.lit(0)).alias("routes"),
                    F.coalesce("avg_headway_min", F.lit(0.0)).alias("avg_headway_min"),
                    F.coalesce("stops", F.lit(0)).alias("stops"),
                    F.coalesce("peak_hour_trips", F.lit(0)).alias("peak_hour_trips"))


def record_counts(df: DataFrame) -> DataFrame:
    """Row count per city."""
    return df.groupBy(*city_keys(df)).agg(F.count(F.lit(1)).alias("records"))


def total_routes_rollup(city_rows: DataFrame) -> DataFrame:
    """Sum of total_routes over cities and the number of cities."""
    return city_rows.agg(F.sum(F.coalesce("total_routes", F.lit(0))).alias("total_routes"),
                         F.count(F.lit(1)).alias("cities"))


def route_frequency_mix(route_stats: DataFrame) -> DataFrame:
    """Routes and share of routes per frequency bucket (low < 50 <= medium <= 100 < high)."""
    keys = city_keys(route_stats)
    t = F.col("num_trips")
    bucket = (F.when(t < K.LOW_FREQUENCY_TRIPS, F.lit("low"))
               .when(t <= K.HIGH_FREQUENCY_TRIPS, F.lit("medium")).otherwise(F.lit("high")))
    counts = route_stats.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("routes"))
    totals = route_stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = join_keys(counts, totals, keys)
    return j.select(*keys, "bucket", "routes", (F.col("routes") / F.col("_n") * 100).alias("share_pct"))
