"""Top-k lists per city, each with a stated tie-break.

Ranking uses ``row_number() <= k`` over ``partitionBy(city)``; Spark plans a
partial group limit before the shuffle, so each city's window sees at most
k rows per upstream partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.functions.labels import route_label, route_name, stop_label
from mobilis.operators.common import city_keys, join_keys


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """First k rows per city by ``order``, with a ``rank`` column (1 = first)."""
    keys = city_keys(df)
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def busiest_routes(route_stats: DataFrame, k: int = 20, names: str = "fallback") -> DataFrame:
    """Top k routes by trips (ties: smaller route_id) with a display name.

    ``names='fallback'``: long name, else short name, else ``Route <id>``;
    ``names='id'``: always ``Route <id>``.
    """
    keys = city_keys(route_stats)
    name = (route_name() if names == "fallback"
            else F.concat(F.lit("Route "), F.col("route_id").cast("string")))
    ranked = top_k(route_stats, k, [F.col("num_trips").desc(), F.col("route_id").asc()])
    return ranked.select(*keys, "rank", "route_id", name.alias("route_name"), "num_trips")


def top_routes(route_stats: DataFrame, k: int = 10) -> DataFrame:
    keys = city_keys(route_stats)
    ranked = top_k(route_stats, k, [F.col("num_trips").desc(), F.col("route_id").asc()])
    return ranked.select(*keys, "rank", "route_id", route_label().alias("route_label"), "num_trips")


def least_used_routes(route_stats: DataFrame, k: int = 10) -> DataFrame:
    keys = city_keys(route_stats)
    ranked = top_k(route_stats, k, [F.col("num_trips").asc(), F.col("route_id").asc()])
    return ranked.select(*keys, "rank", "route_id", route_label().alias("route_label"), "num_trips")


def transfer_points(spatial_stats: DataFrame, k: int = 10) -> DataFrame:
    """Top k stops by number of routes (ties: smaller stop_id), label = first 20 chars."""
    keys = city_keys(spatial_stats)
    ranked = top_k(spatial_stats, k, [F.col("num_routes").desc(), F.col("stop_id").asc()])
    return ranked.select(*keys, "rank", "stop_id", stop_label().alias("stop_label"), "num_routes")


def busiest_route(route_stats: DataFrame) -> DataFrame:
    """The route with most trips per city (ties: smaller route_id)."""
    keys = city_keys(route_stats)
    t = F.col("num_trips")
    return route_stats.groupBy(*keys).agg(
        F.min_by("route_id", F.struct((-t).alias("t"), F.col("route_id"))).alias("route_id"),
        F.max(t).alias("num_trips"))


def route_intensity(route_stats: DataFrame, hourly_service: DataFrame) -> DataFrame:
    """Route stats + trips at the city's modal hour and service_intensity = those trips / stops.

    The modal hour is the most frequent ``arrival_hour`` over (route, hour)
    rows, the smallest hour on a tie -- not the busiest hour. Routes with no
    service at that hour get null trips and null intensity.
    """
    keys = city_keys(route_stats)
    hour = F.col("arrival_hour")
    freq = hourly_service.groupBy(*keys, "arrival_hour").agg(F.count(F.lit(1)).alias("_n"))
    mode = freq.groupBy(*keys).agg(
        F.min_by(hour, F.struct((-F.col("_n")).alias("n"), hour)).alias("arrival_hour"))
    # One row per city: always small.
    at_peak = (hourly_service.join(F.broadcast(mode), keys + ["arrival_hour"])
               .groupBy(*keys, "route_id").agg(F.sum("hourly_trips").alias("hourly_trips")))
    ra = route_stats.join(at_peak, keys + ["route_id"], "left")
    return ra.withColumn("service_intensity", F.try_divide(F.col("hourly_trips"), F.col("num_stops")))


def demand_service_gap(route_stats: DataFrame, hourly_service: DataFrame, k: int = 10) -> DataFrame:
    """Routes with more stops than the city median and intensity below the median intensity.

    Top k by stops (ties: smaller route_id). A null intensity is never below
    the median, so routes without service at the modal hour drop out.
    """
    keys = city_keys(route_stats)
    ra = route_intensity(route_stats, hourly_service)
    med = ra.groupBy(*keys).agg(F.percentile("num_stops", 0.5).alias("_ms"),
                                F.percentile("service_intensity", 0.5).alias("_mi"))
    j = join_keys(ra, med, keys)
    gap = j.where((F.col("num_stops") > F.col("_ms")) & (F.col("service_intensity") < F.col("_mi")))
    ranked = top_k(gap, k, [F.col("num_stops").desc(), F.col("route_id").asc()])
    return ranked.select(*keys, "rank", "route_id", route_label().alias("route_label"), "num_stops",
                         "num_trips", "hourly_trips", "service_intensity")


def underserved_vs_average(route_stats: DataFrame, hourly_service: DataFrame, top: int = 5) -> DataFrame:
    """Mean intensity of the first ``top`` gap routes against the mean over all routes."""
    keys = city_keys(route_stats)
    gap = demand_service_gap(route_stats, hourly_service, k=top)
    under = gap.groupBy(*keys).agg(F.avg("service_intensity").alias("underserved_intensity"))
    allr = route_intensity(route_stats, hourly_service).groupBy(*keys).agg(
        F.avg("service_intensity").alias("city_average_intensity"))
    return join_keys(under, allr, keys)
