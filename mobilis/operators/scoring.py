"""Scoring of given rides: distance, duration, surge parts, surge multiplier, tariff fare.

Lookup tables (tariff, festival dates, city-month extras) are
the fixed values in ``mobilis.constants``: a few dozen rows whatever the
data size, so they are broadcast. Nothing here is random; where the original
rules draw noise or bad weather, an optional input column supplies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis import constants as K
from mobilis.functions.geo import haversine_km
from mobilis.functions.surge import clamp_surge, estimated_duration, season_surge, time_band_surge, weekend_surge


# ---------------------------------------------------------------- fixed lookup tables
def tariff_table(spark: SparkSession) -> DataFrame:
    schema = "service string, vehicle_type string, base double, per_km double, per_min double, booking_fee double"
    return spark.createDataFrame(K.TARIFF, schema)


def festival_table(spark: SparkSession) -> DataFrame:
    rows = [(m, d, add) for m, days, add in K.FESTIVAL_DATES for d in days]
    return spark.createDataFrame(rows, "f_month int, f_day int, festival_surge double")


def city_month_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.CITY_MONTH_SURGE, "cm_city string, cm_month int, city_month_surge double")


# ---------------------------------------------------------------- operators
def straight_distance(df: DataFrame, out: str = "straight_km") -> DataFrame:
    return df.withColumn(out, haversine_km("start_lat", "start_lon", "end_lat", "end_lon"))


def area_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.SURGE_AREAS, "city string, lat double, lon double, radius_km double, multiplier double")


#: Columns of the grid around the earth: cells of 0.05 degrees, about 5.5 km from south to north.
GRID_COLUMNS = 7200


def area_cells(areas: DataFrame, columns: int = GRID_COLUMNS) -> DataFrame:
    """(city, cell_y, cell_x, areas): per grid cell the areas (lat, lon, radius_km, multiplier) that reach into it.

    ``areas`` has city, lat, lon, radius_km and multiplier. The cells of an
    area are those of its bounding box; a box around a pole or across the date
    line is followed. Areas with a null or no positive radius reach nowhere.
    """
    size = 360.0 / columns
    reach = F.col("radius_km") / F.lit(K.EARTH_RADIUS_KM)
    dlat = F.degrees(reach) + 1e-9
    south, north = F.col("lat") - dlat, F.col("lat") + dlat
    wide = (north >= 90) | (south <= -90) | (reach >= 1.5)
    dlon = F.when(wide, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(reach) / F.cos(F.radians("lat"))))) + 1e-9)
    row = lambda x: F.floor(x / size).cast("int")
    rows = F.sequence(row(F.greatest(south, F.lit(-90.0))), row(F.least(north, F.lit(90.0))))
    first, last = row(F.col("lon") - dlon + 180), row(F.col("lon") + dlon + 180)
    across = F.sequence(first, F.least(last, first + F.lit(columns - 1)))
    cells = areas.where("radius_km > 0").withColumn("cell_y", F.explode(rows)).withColumn("_x", F.explode(across))
    cells = cells.withColumn("cell_x", F.pmod("_x", F.lit(columns)))
    area = F.struct("lat", "lon", "radius_km", "multiplier")
    return cells.groupBy("city", "cell_y", "cell_x").agg(F.sort_array(F.collect_list(area)).alias("areas"))


def area_surge(df: DataFrame, lat: str = "start_lat", lon: str = "start_lon", city: str = "city",
               out: str = "area_surge", areas: DataFrame | None = None, columns: int = GRID_COLUMNS) -> DataFrame:
    """Sum over the city's surge areas within radius of multiplier * (1 - d / radius).

    ``areas`` are the fixed ones unless given. They lie in a grid: a row is
    joined to its cell by equality and measured against the areas that reach
    into that cell, so its cost does not grow with the number of areas. A city
    without areas, and a row without a place, scores 0; a point exactly on the
    radius adds 0.
    """
    size = 360.0 / columns
    cells = area_cells(area_table(df.sparkSession) if areas is None else areas, columns)
    cells = cells.select(F.col("city").alias("_a_city"), F.col("cell_y").alias("_a_y"), F.col("cell_x").alias("_a_x"), F.col("areas").alias("_areas"))
    y = F.floor(F.col(lat) / size).cast("int")
    x = F.pmod(F.floor((F.col(lon) + 180) / size), F.lit(columns)).cast("int")
    near = df.join(cells, (F.col(city) == F.col("_a_city")) & (y == F.col("_a_y")) & (x == F.col("_a_x")), "left")

    def share(area: Column) -> Column:
        d = haversine_km(F.col(lat), F.col(lon), area["lat"], area["lon"])
        return F.when(d <= area["radius_km"], area["multiplier"] * (F.lit(1.0) - d / area["radius_km"])).otherwise(0.0)

    score = F.aggregate(F.coalesce("_areas", F.array().cast(cells.schema["_areas"].dataType)), F.lit(0.0), lambda total, area: total + share(area))
    return near.withColumn(out, score).drop("_a_city", "_a_y", "_a_x", "_areas")


def calendar_surge(df: DataFrame, ts: str = "timestamp", city: str = "city",
                   out: str = "calendar_surge") -> DataFrame:
    """Festival-date surge (one entry per month: exclusive) plus city-month extra (additive)."""
    spark = df.sparkSession
    m, d = F.month(F.col(ts)), F.dayofmonth(F.col(ts))
    j = (df.join(F.broadcast(festival_table(spark)), (m == F.col("f_month")) & (d == F.col("f_day")), "left")
           .join(F.broadcast(city_month_table(spark)),
                 (F.col(city) == F.col("cm_city")) & (m == F.col("cm_month")), "left"))
    score = F.coalesce(F.col("festival_surge"), F.lit(0.0)) + F.coalesce(F.col("city_month_surge"), F.lit(0.0))
    return j.withColumn(out, score).drop("f_month", "f_day", "festival_surge", "cm_city", "cm_month",
                                         "city_month_surge")


def surge_parts(df: DataFrame, ts: str = "timestamp", bad_weather: str | None = None) -> DataFrame:
    """time_band_surge, weekend_surge, season_surge, calendar_surge and area_surge columns."""
    df = df.withColumns({
        "time_band_surge": time_band_surge(ts),
        "weekend_surge": weekend_surge(ts),
        "season_surge": season_surge(ts, bad_weather),
    })
    return area_surge(calendar_surge(df, ts))


def surge_multiplier(df: DataFrame, ts: str = "timestamp", noise: str | None = None,
                     bad_weather: str | None = None, out: str = "surge_score") -> DataFrame:
    """1 + time band + weekend + calendar + area + season (+ noise column), clamped to [1, 5]."""
    p = surge_parts(df, ts, bad_weather)
    total = (F.lit(1.0) + F.col("time_band_surge") + F.col("weekend_surge") + F.col("calendar_surge")
             + F.col("area_surge") + F.col("season_surge"))
    if noise:
        total = total + F.coalesce(F.col(noise), F.lit(0.0))
    return p.withColumn(out, clamp_surge(total))


def tariff_fare(df: DataFrame, service: str = "service", vehicle: str = "vehicle_type",
                km: str = "distance_km", minutes: str = "duration_mins", surge: str = "surge_multiplier",
                out: str = "tariff_fare") -> DataFrame:
    """(base + per_km*km + per_min*min + booking) * surge, to the nearest 10 (half to even).

    Unknown (service, vehicle) pairs give 0.
    """
    t = tariff_table(df.sparkSession).withColumnsRenamed({"service": "_t_service", "vehicle_type": "_t_vehicle"})
    j = df.join(F.broadcast(t), (F.col(service) == F.col("_t_service")) & (F.col(vehicle) == F.col("_t_vehicle")),
                "left")
    raw = (F.col("base") + F.col("per_km") * F.col(km) + F.col("per_min") * F.col(minutes)
           + F.col("booking_fee")) * F.col(surge)
    fare = F.when(F.col("_t_service").isNull(), F.lit(0.0)).otherwise(F.bround(raw / 10, 0) * 10)
    return j.withColumn(out, fare).drop("_t_service", "_t_vehicle", "base", "per_km", "per_min", "booking_fee")


def ride_demand_struct(df: DataFrame, ts: str = "timestamp", out: str = "demand_features") -> DataFrame:
    """Nested hour_of_day, day_of_week (Monday=0), is_peak_hour (7-10 or 17-20), is_weekend."""
    h, wd = F.hour(F.col(ts)), F.weekday(F.col(ts))
    peak = None
    for lo, hi in K.RECORD_PEAK_BANDS:
        part = (h >= lo) & (h <= hi)
        peak = part if peak is None else peak | part
    return df.withColumn(out, F.struct(
        h.alias("hour_of_day"), wd.alias("day_of_week"),
        F.when(peak, 1).otherwise(0).alias("is_peak_hour"),
        F.when(wd >= 5, 1).otherwise(0).alias("is_weekend")))


def score_rides(rides: DataFrame, traffic_factor=1.0, noise: str | None = None,
                bad_weather: str | None = None) -> DataFrame:
    """Score given rides with the pricing rules.

    straight_km (haversine), est_duration_mins, surge_score (rounded to 2
    decimals like a stored record), tariff_fare priced with the record's own
    distance, duration and the computed surge, and the demand struct.
    """
    s = straight_distance(rides)
    s = s.withColumn("est_duration_mins", estimated_duration("straight_km", traffic_factor))
    s = surge_multiplier(s, noise=noise, bad_weather=bad_weather)
    s = s.withColumn("surge_score", F.bround("surge_score", 2))
    s = tariff_fare(s, surge="surge_score")
    return ride_demand_struct(s)
