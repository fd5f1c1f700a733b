"""Ride-hailing analytics: preparation, pricing and surge patterns, features, city comparison.

All per-city work is one ``groupBy`` that includes ``city`` (one scan for
all cities, instead of one job per city).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis import constants as K
from mobilis.functions.rides import fare_per_km, fare_per_km_or_fare, is_peak_hour, ride_time_features, speed_kmh
from mobilis.operators.common import city_keys, join_keys



# ---------------------------------------------------------------- preparation
def ride_ratios(rides: DataFrame) -> DataFrame:
    """fare_per_km = fare / km and speed_kmh = km / (min / 60); null where a divisor is 0."""
    return rides.withColumns({"fare_per_km": fare_per_km(), "speed_kmh": speed_kmh()})


def ride_outlier_filter(rides: DataFrame) -> DataFrame:
    """Keep 0.5 < km < 100, 10 < fare < 5000, 1 < minutes < 180 (all strict)."""
    km, fare, mins = F.col("distance_km"), F.col("fare"), F.col("duration_mins")
    return rides.where((km > K.RIDE_KM_RANGE[0]) & (km < K.RIDE_KM_RANGE[1])
                       & (fare > K.RIDE_FARE_RANGE[0]) & (fare < K.RIDE_FARE_RANGE[1])
                       & (mins > K.RIDE_MIN_RANGE[0]) & (mins < K.RIDE_MIN_RANGE[1]))


def preprocess_rides(rides: DataFrame) -> DataFrame:
    """Time features (hour, day_of_week Sunday=1, is_weekend, is_peak_hour 8-11/16-21),
    ratios, then the outlier filter."""
    return ride_outlier_filter(ride_ratios(ride_time_features(rides)))


def with_ride_defaults(rides: DataFrame) -> DataFrame:
    """Add absent numeric columns: fare, distance_km, duration_mins = 0.0; surge_multiplier = 1.0."""
    defaults = {"fare": 0.0, "distance_km": 0.0, "duration_mins": 0.0, "surge_multiplier": 1.0}
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in rides.columns}
    return rides.withColumns(missing) if missing else rides


def ride_feature_columns(rides: DataFrame) -> DataFrame:
    """hour_of_day, day_of_week, is_weekend, is_peak_hour, fare_per_km (fare when km <= 0);
    rows without an hour are dropped."""
    r = with_ride_defaults(rides)
    if dict(r.dtypes).get("timestamp") == "string":
        r = r.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    ts = F.col("timestamp")
    r = r.withColumns({
        "hour_of_day": F.hour(ts),
        "day_of_week": F.dayofweek(ts),
        "is_weekend": F.when(F.dayofweek(ts).isin(1, 7), 1).otherwise(0),
        "is_peak_hour": is_peak_hour(F.hour(ts)),
        "fare_per_km": fare_per_km_or_fare(),
    })
    return r.where(F.col("hour_of_day").isNotNull())


# ---------------------------------------------------------------- patterns
def ride_price_by_type(prepared: DataFrame) -> DataFrame:
    """Per (service, vehicle): mean fare, mean of fare/km (not a ratio of means), mean surge, rides."""
    keys = city_keys(prepared) + ["service", "vehicle_type"]
    return prepared.groupBy(*keys).agg(
        F.avg("fare").alias("avg_fare"), F.avg("fare_per_km").alias("avg_fare_per_km"),
        F.avg("surge_multiplier").alias("avg_surge"), F.count(F.lit(1)).alias("ride_count"))


def ride_distance_by_type(prepared: DataFrame) -> DataFrame:
    keys = city_keys(prepared) + ["service", "vehicle_type"]
    return prepared.groupBy(*keys).agg(
        F.avg("distance_km").alias("avg_distance"), F.avg("duration_mins").alias("avg_duration"),
        F.stddev_samp("distance_km").alias("std_distance"))


def service_popularity(prepared: DataFrame) -> DataFrame:
    keys = city_keys(prepared) + ["service"]
    return prepared.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rides"), F.avg("fare").alias("avg_fare"))


def hourly_surge(prepared: DataFrame) -> DataFrame:
    keys = city_keys(prepared) + ["hour", "service"]
    return prepared.groupBy(*keys).agg(F.avg("surge_multiplier").alias("avg_surge"))


def _split_surge(prepared: DataFrame, flag: str, on_name: str, off_name: str) -> DataFrame:
    """Mean surge per service on each side of a 0/1 flag, in one pass.

    Services with rows on only one side are left out (the inner-join meaning).
    """
    keys = city_keys(prepared) + ["service"]
    on, off = F.col(flag) == 1, F.col(flag) == 0
    s = F.col("surge_multiplier")
    return (prepared.groupBy(*keys).agg(
        F.avg(F.when(on, s)).alias(on_name), F.avg(F.when(off, s)).alias(off_name),
        F.count_if(on).alias("_n_on"), F.count_if(off).alias("_n_off"))
        .where((F.col("_n_on") > 0) & (F.col("_n_off") > 0)).drop("_n_on", "_n_off"))


def peak_vs_offpeak(prepared: DataFrame) -> DataFrame:
    return _split_surge(prepared, "is_peak_hour", "avg_peak_surge", "avg_non_peak_surge")


def weekend_vs_weekday(prepared: DataFrame) -> DataFrame:
    return _split_surge(prepared, "is_weekend", "avg_weekend_surge", "avg_weekday_surge")


def ride_comparison_projection(prepared: DataFrame) -> DataFrame:
    return prepared.select(*city_keys(prepared), "service", "vehicle_type", "fare", "distance_km",
                           "duration_mins", "surge_multiplier", "hour", "is_weekend")


# ---------------------------------------------------------------- features
FEATURE_FILL = {"std_surge_multiplier": 0.0, "avg_price_per_km": 0.0, "avg_fare": 0.0,
                "avg_distance_km": 0.0, "avg_duration_mins": 0.0}


def ride_features(rides: DataFrame) -> DataFrame:
    """Per (city, hour_of_day, is_weekend): means, stddev of surge, ride count.

    Nulls filled with 0 except avg_surge_multiplier.
    """
    r = ride_feature_columns(rides)
    keys = city_keys(r) + ["hour_of_day", "is_weekend"]
    return r.groupBy(*keys).agg(
        F.avg("fare").alias("avg_fare"),
        F.avg("fare_per_km").alias("avg_price_per_km"),
        F.avg("surge_multiplier").alias("avg_surge_multiplier"),
        F.stddev_samp("surge_multiplier").alias("std_surge_multiplier"),
        F.count(F.lit(1)).alias("ride_count"),
        F.avg("distance_km").alias("avg_distance_km"),
        F.avg("duration_mins").alias("avg_duration_mins"),
    ).fillna(FEATURE_FILL)


def demand_index(features: DataFrame) -> DataFrame:
    """is_peak_hour from hour_of_day (8-11, 16-21); demand_index = rides x 1.5 at peak, else rides."""
    peak = is_peak_hour("hour_of_day")
    return features.withColumns({
        "is_peak_hour": peak,
        "demand_index": F.when(peak == 1, F.col("ride_count") * K.PEAK_DEMAND_WEIGHT)
                         .otherwise(F.col("ride_count").cast("double")),
    })


def modeling_dataset(rides: DataFrame) -> DataFrame:
    """ride_features of every city (one grouped pass) plus is_peak_hour and demand_index."""
    return demand_index(ride_features(rides))


def union_cities(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_tagged(frames: dict[str, DataFrame]) -> DataFrame:
    """Tag each frame with its city, then concatenate."""
    return union_cities([f.withColumn("city", F.lit(c)) for c, f in frames.items()])


def simple_ride_dataset(rides: DataFrame) -> DataFrame:
    """Ungrouped rows: surge, hour, weekend, peak, fare, km, minutes, fare_per_km (+ city)."""
    r = ride_feature_columns(rides)
    return r.select("surge_multiplier", "hour_of_day", "is_weekend", "is_peak_hour", "fare", "distance_km",
                    "duration_mins", "fare_per_km", *city_keys(r))


def surge_label(modeling: DataFrame, problem_type: str = "regression") -> DataFrame:
    """label = avg_surge_multiplier (regression) or high_surge = avg > 1.5 (classification), as double.

    A missing label column counts as 0.
    """
    df = modeling
    if problem_type == "regression":
        name = "avg_surge_multiplier"
    else:
        df = df.withColumn("high_surge", F.when(F.col("avg_surge_multiplier") > K.HIGH_SURGE_THRESHOLD, 1)
                           .otherwise(0))
        name = "high_surge"
    if name not in df.columns:
        df = df.withColumn(name, F.lit(0))
    return df.withColumn("label", F.col(name).cast("double"))


# ---------------------------------------------------------------- city comparison
def city_ride_stats(rides: DataFrame) -> DataFrame:
    """Per city: rides, mean fare, km, minutes, surge, distinct services and vehicle types."""
    return rides.groupBy(*city_keys(rides)).agg(
        F.count(F.lit(1)).alias("total_rides"), F.avg("fare").alias("avg_fare"),
        F.avg("distance_km").alias("avg_distance"), F.avg("duration_mins").alias("avg_duration"),
        F.avg("surge_multiplier").alias("avg_surge"), F.countDistinct("service").alias("services"),
        F.countDistinct("vehicle_type").alias("vehicle_types"))


def cross_city_pricing(rides: DataFrame, cities: list[str]) -> DataFrame:
    """Services present in every listed city: mean fare and mean of fare/km per city.

    Columns ``{city}_avg_fare`` and ``{city}_fare_per_km``. A zero distance
    gives a null ratio, which the mean skips.
    """
    g = (rides.groupBy("service").pivot("city", cities)
         .agg(F.avg("fare").alias("avg_fare"), F.avg(fare_per_km()).alias("fare_per_km"),
              F.count(F.lit(1)).alias("n")))
    present = reduce(lambda a, b: a & b, [F.col(f"{c}_n") > 0 for c in cities])
    return g.where(present).drop(*[f"{c}_n" for c in cities])


def fare_pivot(rides: DataFrame, services: list[str] | None = None) -> DataFrame:
    """city x service mean fare (absent cell = null), for every service present unless a list is given."""
    return rides.groupBy("city").pivot("service", services).agg(F.avg("fare"))


def service_mix_pivot(rides: DataFrame, services: list[str] | None = None) -> DataFrame:
    """city x service ride count (absent cell = null), for every service present unless a list is given."""
    return rides.groupBy("city").pivot("service", services).agg(F.count(F.lit(1)))


def fare_distance_points(rides: DataFrame) -> DataFrame:
    """(city, service, distance_km, fare) of every ride."""
    return rides.select(*city_keys(rides), "service", "distance_km", "fare")


def model_city_summary(modeling: DataFrame) -> DataFrame:
    """Per city: mean of avg_surge_multiplier and total ride_count."""
    return modeling.groupBy(*city_keys(modeling)).agg(
        F.avg("avg_surge_multiplier").alias("avg_surge_multiplier"),
        F.sum("ride_count").alias("ride_count"))


def ride_comparison(rides: DataFrame, cities: list[str]) -> DataFrame:
    """Per-city ride statistics next to the number of services priced in every city."""
    shared = cross_city_pricing(rides, cities).agg(F.count(F.lit(1)).alias("shared_services"))
    return join_keys(city_ride_stats(rides), shared, [])
