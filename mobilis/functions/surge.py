"""Surge-score parts as column expressions.

Hour and weekday parts follow the ride scoring rules: weekday() counts
Monday as 0, so Saturday and Sunday are 5 and 6.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mobilis import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def time_band_surge(ts="timestamp") -> Column:
    """Peak 0.4, else lunch 0.2, else late night 0.5, else 0 (first match wins)."""
    h = F.hour(_c(ts))
    peak = None
    for lo, hi in K.PEAK_BANDS:
        part = (h >= lo) & (h <= hi)
        peak = part if peak is None else (peak | part)
    lo, hi = K.LUNCH_BAND
    return (F.when(peak, F.lit(K.PEAK_SURGE))
             .when((h >= lo) & (h <= hi), F.lit(K.LUNCH_SURGE))
             .when((h >= K.LATE_NIGHT_FROM) | (h <= K.LATE_NIGHT_TO), F.lit(K.LATE_NIGHT_SURGE))
             .otherwise(F.lit(0.0)))


def weekend_surge(ts="timestamp") -> Column:
    """Saturday/Sunday 0.3, else Friday from 16h 0.2, else 0."""
    wd = F.weekday(_c(ts))
    return (F.when(wd >= 5, F.lit(K.WEEKEND_SURGE))
             .when((wd == 4) & (F.hour(_c(ts)) >= K.FRIDAY_EVENING_FROM), F.lit(K.FRIDAY_EVENING_SURGE))
             .otherwise(F.lit(0.0)))


def season_surge(ts="timestamp", bad_weather=None) -> Column:
    """June-September 0.3; plus 0.4 where an optional bad-weather flag column is 1."""
    m = F.month(_c(ts))
    base = F.when(m.between(*K.MONSOON_MONTHS), F.lit(K.MONSOON_SURGE)).otherwise(F.lit(0.0))
    if bad_weather is None:
        return base
    return base + F.when(_c(bad_weather) == 1, F.lit(K.BAD_WEATHER_SURGE)).otherwise(F.lit(0.0))


def clamp_surge(x: Column) -> Column:
    return F.greatest(F.lit(K.SURGE_MIN), F.least(F.lit(K.SURGE_MAX), x))


def estimated_duration(km="distance_km", traffic_factor=1.0) -> Column:
    """max(5, km / 25 * 60 * factor) rounded half-even to whole minutes."""
    f = _c(traffic_factor) if isinstance(traffic_factor, (str, Column)) else F.lit(float(traffic_factor))
    mins = _c(km) / F.lit(K.URBAN_SPEED_KMH) * F.lit(60.0) * f
    return F.bround(F.greatest(F.lit(float(K.MIN_TRIP_MINUTES)), mins), 0)
