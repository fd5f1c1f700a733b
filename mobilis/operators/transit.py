"""Stop-event fact table and the route, headway, hourly and stop metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mobilis.constants import HEADWAY_MAX_SECONDS
from mobilis.functions.timeparse import parse_service_time
from mobilis.operators.bitmaps import NUMBERS, distinct_count, numbered
from mobilis.operators.clean import clean_routes, clean_stops, clean_trips, present_stop_times
from mobilis.operators.common import city_keys, side_by_side


def trip_stop_events(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Inner join stop_times - trips (trip_id) - routes (route_id) - stops (stop_id).

    Inputs are expected cleaned. Orphans drop. The tenant key joins too. No
    join carries a hint: the planner and adaptive execution choose by the
    measured bytes of each side, and skewed partitions are split.
    """
    ck = city_keys(stop_times)
    events = stop_times.join(trips, ck + ["trip_id"], "inner")
    return events.join(routes, ck + ["route_id"], "inner").join(stops, ck + ["stop_id"], "inner")


def build_events(feed: dict[str, DataFrame], malformed: str = "midnight") -> DataFrame:
    """Clean the four feed tables and join them into the stop-event fact.

    Clock times are parsed after the joins: the text is narrower to shuffle
    than what is parsed from it. trip_no, stop_no and route_no number the
    dimension rows for exact distinct counts; the trips of a route lie next
    to each other.
    """
    ck = city_keys(feed["trips"])
    trips = numbered(clean_trips(feed["trips"]), ck + ["route_id", "trip_id"], "trip_no")
    routes = numbered(clean_routes(feed["routes"]), city_keys(feed["routes"]) + ["route_id"], "route_no")
    stops = numbered(clean_stops(feed["stops"]), city_keys(feed["stops"]) + ["stop_id"], "stop_no")
    events = trip_stop_events(present_stop_times(feed["stop_times"]), trips, routes, stops)
    return parse_service_time(events, "arrival_time", "arrival", malformed)


def _estimates(events: DataFrame, keys: list[str], counts: dict[str, str]) -> DataFrame:
    """HyperLogLog++ estimates (rsd 1%) of distinct counts: an option for very large feeds."""
    return events.groupBy(*keys).agg(*[F.approx_count_distinct(c, 0.01).alias(name) for c, name in counts.items()])


def _distincts(events: DataFrame, keys: list[str], counts: dict[str, str], exact: bool) -> list[DataFrame]:
    if not exact:
        return [_estimates(events, keys, counts)]
    return [distinct_count(events, keys, c, name) for c, name in counts.items()]


def route_stats(events: DataFrame, exact: bool = True) -> DataFrame:
    """Per route: distinct trips, stops, services; events; mean and sample stddev of hour.

    Each distinct count is an aggregate of its own over a few columns of the
    fact (a stored one, best); rows are never expanded.
    """
    keys = city_keys(events) + ["route_id", "route_short_name", "route_long_name"]
    services = F.countDistinct("service_id") if exact else F.approx_count_distinct("service_id", 0.01)
    plain = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_stop_events"), F.avg("arrival_hour").alias("avg_service_hour"),
        F.stddev_samp("arrival_hour").alias("std_service_hour"), services.alias("num_services"))
    merged = side_by_side([plain, *_distincts(events, keys, {"trip_id": "num_trips", "stop_id": "num_stops"}, exact)], keys)
    return merged.select(*keys, "num_trips", "num_stops", "total_stop_events", "avg_service_hour", "std_service_hour", "num_services")


def hourly_service(events: DataFrame, exact: bool = True) -> DataFrame:
    """Per (route, arrival hour): events, distinct trips, distinct stops."""
    keys = city_keys(events) + ["route_id", "arrival_hour"]
    plain = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("hourly_stop_events"))
    merged = side_by_side([plain, *_distincts(events, keys, {"trip_id": "hourly_trips", "stop_id": "hourly_stops"}, exact)], keys)
    return merged.select(*keys, "hourly_stop_events", "hourly_trips", "hourly_stops")


def spatial_stats(events: DataFrame, exact: bool = True) -> DataFrame:
    """Per stop: distinct routes and trips, events, mean lat/lon (rows with both kept)."""
    keys = city_keys(events) + ["stop_id", "stop_name"]
    plain = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_events"), F.avg("stop_lat").alias("avg_lat"), F.avg("stop_lon").alias("avg_lon"))
    merged = side_by_side([plain, *_distincts(events, keys, {"route_id": "num_routes", "trip_id": "num_trips"}, exact)], keys)
    return (merged.where(F.col("avg_lat").isNotNull() & F.col("avg_lon").isNotNull())
            .select(*keys, "num_routes", "num_trips", "total_events", "avg_lat", "avg_lon"))


def headway_gaps(events: DataFrame, max_seconds: int = HEADWAY_MAX_SECONDS) -> DataFrame:
    """(route, stop, arrival_total_seconds, prev_arrival, headway_seconds) of gaps with 0 < gap < max_seconds.

    Arrivals in the same second give one positive gap and zeros, which the
    open bound drops, so gaps are read from the set of distinct seconds: a
    hash aggregate over numbers that collapses hot keys map-side, after which
    each window partition holds at most one row per clock second, however
    skewed the route is.
    """
    keys = city_keys(events) + ["route_id", "stop_id"]
    secs = "arrival_total_seconds"
    w = Window.partitionBy(*keys).orderBy(secs)
    gaps = events.select(*keys, secs).distinct().withColumn("prev_arrival", F.lag(secs).over(w))
    gap = F.col(secs) - F.col("prev_arrival")
    return gaps.withColumn("headway_seconds", gap).where((gap > 0) & (gap < max_seconds))


def headways(events: DataFrame, max_seconds: int = HEADWAY_MAX_SECONDS) -> DataFrame:
    """Gap to the previous arrival at the same (route, stop), with the event it belongs to.

    Of several events in one second the first by trip_id and stop_sequence
    has the gap. Only events at a second with a gap take part in that choice;
    a stored fact is read twice. Direction and service day are not part of
    the partition (kept meaning). Summaries of the gaps alone need
    ``headway_gaps`` only.
    """
    keys = city_keys(events) + ["route_id", "stop_id", "arrival_total_seconds"]
    columns = [c for c in events.columns if c not in NUMBERS.values()]
    at = events.select(*columns).join(headway_gaps(events, max_seconds), keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("trip_id", "stop_sequence"))
    return at.withColumn("_first", first).where("_first = 1").select(*columns, "prev_arrival", "headway_seconds")


#: Columns of the fact that each metric reads, besides the city.
METRIC_COLUMNS = {
    "route_stats": ["route_id", "route_short_name", "route_long_name", "service_id", "arrival_hour", "trip_no", "stop_no"],
    "headway_gaps": ["route_id", "stop_id", "arrival_total_seconds"],
    "hourly_service": ["route_id", "arrival_hour", "trip_no", "stop_no"],
    "spatial_stats": ["stop_id", "stop_name", "stop_lat", "stop_lon", "route_no", "trip_no"],
}
METRICS = {"route_stats": route_stats, "headways": headways, "headway_gaps": headway_gaps, "hourly_service": hourly_service,
           "spatial_stats": spatial_stats}


def metric_columns(events: DataFrame, metrics: list[str]) -> list[str]:
    """The columns of the fact that the named metrics read, each once; all of them for ``headways``."""
    if "headways" in metrics:
        return events.columns
    wanted = [c for m in metrics for c in METRIC_COLUMNS[m]]
    return city_keys(events) + list(dict.fromkeys(wanted))


def transit_metrics(events: DataFrame) -> dict[str, DataFrame]:
    """The four metric tables of a fact, which each reads more than once: pass a stored one."""
    return {m: METRICS[m](events) for m in ("route_stats", "headways", "hourly_service", "spatial_stats")}
