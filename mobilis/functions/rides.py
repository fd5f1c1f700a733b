"""Ride time features and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilis.constants import PEAK_BANDS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_peak_hour(hour="hour", bands=PEAK_BANDS) -> Column:
    """1 when the hour lies in any inclusive band (default 8-11 or 16-21), else 0."""
    h = _c(hour)
    cond = None
    for lo, hi in bands:
        part = (h >= lo) & (h <= hi)
        cond = part if cond is None else (cond | part)
    return F.when(cond, 1).otherwise(0)


def is_weekend(ts="timestamp") -> Column:
    """1 on Sunday (dayofweek 1) or Saturday (7), else 0."""
    return F.when(F.dayofweek(_c(ts)).isin(1, 7), 1).otherwise(0)


def ride_time_features(df: DataFrame, ts: str = "timestamp", hour_name: str = "hour") -> DataFrame:
    """Cast the timestamp; add hour, day_of_week (Sunday=1), is_weekend, is_peak_hour."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp_ntz")) if dict(df.dtypes).get(ts) == "string" else df
    return df.withColumns({
        hour_name: F.hour(ts),
        "day_of_week": F.dayofweek(ts),
        "is_weekend": F.when(F.dayofweek(ts).isin(1, 7), 1).otherwise(0),
        "is_peak_hour": is_peak_hour(F.hour(ts)),
    })


def fare_per_km(fare="fare", km="distance_km") -> Column:
    """Plain ratio; null when the distance is 0 (no ANSI division error)."""
    return F.try_divide(_c(fare), _c(km))


def fare_per_km_or_fare(fare="fare", km="distance_km") -> Column:
    """Ratio when distance > 0, else the fare itself (feature rule)."""
    return F.when(_c(km) > 0, F.try_divide(_c(fare), _c(km))).otherwise(_c(fare))


def speed_kmh(km="distance_km", minutes="duration_mins") -> Column:
    return F.try_divide(_c(km), F.try_divide(_c(minutes), F.lit(60.0)))
