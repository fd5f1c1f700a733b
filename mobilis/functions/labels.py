"""Display labels for routes and stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nonblank(c: Column) -> Column:
    s = c.cast("string")
    return F.when(F.trim(s) != "", s)


def route_label(long_name="route_long_name", short_name="route_short_name",
                route_id="route_id") -> Column:
    """Long name if not null and not blank, else short name (same test), else the id."""
    return F.coalesce(_nonblank(F.col(long_name)), _nonblank(F.col(short_name)),
                      F.col(route_id).cast("string"))


def route_name(long_name="route_long_name", short_name="route_short_name",
               route_id="route_id") -> Column:
    """Name for the mapping report: long, else short (null test only), else ``Route <id>``."""
    return F.coalesce(F.when(F.col(long_name).cast("string") != "", F.col(long_name).cast("string")),
                      F.when(F.col(short_name).cast("string") != "", F.col(short_name).cast("string")),
                      F.concat(F.lit("Route "), F.col(route_id).cast("string")))


def stop_label(stop_name="stop_name", width: int = 20) -> Column:
    """First ``width`` characters of the stop name."""
    return F.substring(F.col(stop_name), 1, width)
