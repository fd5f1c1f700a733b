"""Column expressions built from Spark's built-in functions (no Python UDFs)."""

from mobilis.functions.timeparse import parse_service_time, service_seconds
from mobilis.functions.geo import haversine_km
from mobilis.functions.labels import route_label, route_name, stop_label
from mobilis.functions.rides import (
    is_peak_hour, is_weekend, ride_time_features, fare_per_km, fare_per_km_or_fare, speed_kmh,
)
from mobilis.functions.surge import (
    time_band_surge, weekend_surge, season_surge, clamp_surge, estimated_duration,
)

__all__ = [
    "parse_service_time", "service_seconds", "haversine_km", "route_label", "route_name",
    "stop_label", "is_peak_hour", "is_weekend", "ride_time_features", "fare_per_km",
    "fare_per_km_or_fare", "speed_kmh", "time_band_surge", "weekend_surge", "season_surge",
    "clamp_surge", "estimated_duration",
]
