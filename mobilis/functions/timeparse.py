"""GTFS clock-time parsing.

A clock time is text ``H:MM:SS`` or ``HH:MM:SS`` counted from the start of the
service day, so hours of 24 and more are legal. Text that does not match the
pattern becomes ``00:00:00`` (it still counts, in hour 0); minutes and seconds
are not range-checked. Both rules are kept on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilis.constants import MALFORMED_TIME, SERVICE_TIME_PATTERN


def _parts(text: Column):
    pieces = F.split(text, ":")
    # The regex guard makes the three pieces present and numeric; get() and
    # try_cast keep the expression safe under ANSI mode anyway.
    return [F.get(pieces, i).try_cast("int") for i in range(3)]


def service_seconds(text: Column) -> Column:
    """Seconds since service-day start of a clock-time text column."""
    h, m, s = _parts(F.when(text.rlike(SERVICE_TIME_PATTERN), text).otherwise(F.lit(MALFORMED_TIME)))
    return h * 3600 + m * 60 + s


def parse_service_time(df: DataFrame, column: str = "arrival_time", prefix: str = "arrival",
                       malformed: str = "midnight") -> DataFrame:
    """Add ``{prefix}_time_clean``, ``_hour``, ``_minute``, ``_second``, ``_total_seconds``.

    ``malformed='midnight'`` keeps the reference meaning; ``'drop'`` removes
    rows whose text does not match instead.
    """
    text = F.col(column)
    ok = text.rlike(SERVICE_TIME_PATTERN)
    if malformed == "drop":
        df = df.where(ok)
    elif malformed != "midnight":
        raise ValueError("malformed must be 'midnight' or 'drop'")
    clean = F.when(ok, text).otherwise(F.lit(MALFORMED_TIME))
    h, m, s = _parts(F.col(f"{prefix}_time_clean"))
    return (df.withColumn(f"{prefix}_time_clean", clean)
              .withColumns({f"{prefix}_hour": h, f"{prefix}_minute": m, f"{prefix}_second": s})
              .withColumn(f"{prefix}_total_seconds",
                          F.col(f"{prefix}_hour") * 3600 + F.col(f"{prefix}_minute") * 60
                          + F.col(f"{prefix}_second")))
