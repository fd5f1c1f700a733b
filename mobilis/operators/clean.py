"""Cleaning of feed tables (one row per key; required fields present)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.functions.timeparse import parse_service_time
from mobilis.operators.common import city_keys, one_row_per_key


def clean_routes(routes: DataFrame) -> DataFrame:
    return one_row_per_key(routes, city_keys(routes) + ["route_id"])


def clean_trips(trips: DataFrame) -> DataFrame:
    return one_row_per_key(trips, city_keys(trips) + ["trip_id"])


def clean_stops(stops: DataFrame) -> DataFrame:
    return one_row_per_key(stops, city_keys(stops) + ["stop_id"])


def present_stop_times(stop_times: DataFrame) -> DataFrame:
    """Rows with trip_id, stop_id and arrival_time."""
    return stop_times.where(F.col("trip_id").isNotNull() & F.col("stop_id").isNotNull() & F.col("arrival_time").isNotNull())


def clean_stop_times(stop_times: DataFrame, malformed: str = "midnight") -> DataFrame:
    """Drop rows missing trip_id, stop_id or arrival_time (no dedup), then parse times."""
    return parse_service_time(present_stop_times(stop_times), "arrival_time", "arrival", malformed)
