"""Edge fixtures for the ride operators and scoring rules."""

import datetime as dt

from pyspark.sql import functions as F

from mobilis.operators import rides as R
from mobilis.operators import scoring as P

SCHEMA = ("ride_id string, city string, timestamp timestamp_ntz, service string, vehicle_type string, "
          "start_lat double, start_lon double, end_lat double, end_lon double, distance_km double, "
          "duration_mins double, surge_multiplier double, fare double")


def _ride(i, city="delhi", ts=dt.datetime(2024, 1, 3, 9), service="uber", vehicle="mini", km=5.0, mins=20.0,
          surge=1.0, fare=100.0, lat=28.6139, lon=77.2090):
    return (str(i), city, ts, service, vehicle, lat, lon, lat, lon, km, mins, surge, fare)


def test_zero_distance_ratios(spark):
    df = spark.createDataFrame([_ride(1, km=0.0, fare=100.0)], SCHEMA)
    assert R.ride_ratios(df).first().fare_per_km is None
    assert R.ride_feature_columns(df).first().fare_per_km == 100.0


def test_outlier_bounds_strict(spark):
    rows = [_ride(1, km=0.5), _ride(2, km=100.0), _ride(3, fare=10.0), _ride(4, fare=5000.0),
            _ride(5, mins=1.0), _ride(6, mins=180.0), _ride(7)]
    out = R.preprocess_rides(spark.createDataFrame(rows, SCHEMA))
    assert [r.ride_id for r in out.collect()] == ["7"]


def test_one_sided_service_and_one_city_service(spark):
    rows = [_ride(1, service="uber", ts=dt.datetime(2024, 1, 3, 9)),   # peak only
            _ride(2, service="ola", ts=dt.datetime(2024, 1, 3, 9)),
            _ride(3, service="ola", ts=dt.datetime(2024, 1, 3, 3)),
            _ride(4, service="ola", city="bangalore"), _ride(5, service="uber", city="delhi")]
    df = R.preprocess_rides(spark.createDataFrame(rows, SCHEMA))
    pvo = {r.service for r in R.peak_vs_offpeak(df).where("city = 'delhi'").collect()}
    assert pvo == {"ola"}
    raw = spark.createDataFrame(rows, SCHEMA)
    pricing = {r.service for r in R.cross_city_pricing(raw, ["delhi", "bangalore"]).collect()}
    assert pricing == {"ola"}
    piv = {r.city: r for r in R.fare_pivot(raw, ["uber", "ola"]).collect()}
    assert piv["bangalore"].uber is None


def test_fare_rounding_and_unknown_pair(spark):
    # uber mini: 45 + 12 km + 1 min; choose inputs so raw fare hits the listed values
    rows = [("a", "uber", "mini", 0.0, 205.0, 1.0),   # 250 -> 250
            ("b", "uber", "mini", 0.0, 305.0, 1.0),   # 350 -> 350
            ("c", "uber", "mini", 0.0, 209.9, 1.0),   # 254.9 -> 250
            ("d", "uber", "mini", 0.0, 5.0, 0.5),      # 25 -> 20 (half to even)
            ("e", "uber", "mini", 0.0, 25.0, 0.5),     # 35 -> 40
            ("f", "uber", "mini", 0.0, 45.0, 0.5),     # 45 -> 40
            ("g", "rapido", "mini", 3.0, 10.0, 1.0)]   # unknown pair -> 0
    df = spark.createDataFrame(rows, "ride_id string, service string, vehicle_type string, distance_km double, "
                                     "duration_mins double, surge_multiplier double")
    got = {r.ride_id: r.tariff_fare for r in P.tariff_fare(df).collect()}
    assert got == {"a": 250.0, "b": 350.0, "c": 250.0, "d": 20.0, "e": 40.0, "f": 40.0, "g": 0.0}


def test_surge_parts(spark):
    rows = [_ride(1, ts=dt.datetime(2024, 1, 5, 15)),   # Friday 15h
            _ride(2, ts=dt.datetime(2024, 1, 5, 16)),   # Friday 16h
            _ride(3, ts=dt.datetime(2024, 1, 6, 12)),   # Saturday
            _ride(4, ts=dt.datetime(2024, 11, 2, 23), city="nowhere")]
    df = P.surge_multiplier(spark.createDataFrame(rows, SCHEMA))
    got = {r.ride_id: r for r in df.collect()}
    assert (got["1"].weekend_surge, got["2"].weekend_surge, got["3"].weekend_surge) == (0.0, 0.2, 0.3)
    assert got["4"].area_surge == 0.0 and got["4"].calendar_surge == 1.5  # unknown city, Diwali date
    assert got["2"].time_band_surge == 0.4 and got["1"].time_band_surge == 0.2


def test_surge_clamp(spark):
    # Saturday 23h in Diwali week in Delhi centre: 1 + 0.5 + 0.3 + 1.5 + ~0.3 (+0.3 Oct only) ... plus noise 3
    rows = [_ride(1, ts=dt.datetime(2024, 11, 2, 23))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("noise", F.lit(3.0))
    assert P.surge_multiplier(df, noise="noise").first().surge_score == 5.0


def test_area_edge(spark):
    from mobilis.functions.geo import haversine_km
    # a point due north of an area centre at exactly its radius adds 0
    lat0, lon0, radius = 12.9784, 77.6408, 2.0
    dlat = radius / 6371.0 * 180 / 3.141592653589793
    rows = [_ride(1, city="bangalore", lat=lat0 + dlat, lon=lon0), _ride(2, city="bangalore", lat=14.0, lon=78.0),
            _ride(3, city="bangalore", lat=lat0, lon=lon0)]
    df = P.area_surge(spark.createDataFrame(rows, SCHEMA))
    got = {r.ride_id: r.area_surge for r in df.collect()}
    assert abs(got["1"]) < 1e-9 and got["2"] == 0.0 and got["3"] >= 0.4
    d = spark.range(1).select(haversine_km(F.lit(lat0), F.lit(lon0), F.lit(lat0 + dlat), F.lit(lon0)).alias("d"))
    assert abs(d.first().d - radius) < 1e-9


def test_demand_struct_and_features(spark):
    rows = [_ride(1, ts=dt.datetime(2024, 1, 6, 7))]  # Saturday 7h
    d = P.ride_demand_struct(spark.createDataFrame(rows, SCHEMA)).first().demand_features
    assert (d.hour_of_day, d.day_of_week, d.is_peak_hour, d.is_weekend) == (7, 5, 1, 1)
    f = R.modeling_dataset(spark.createDataFrame(rows, SCHEMA)).first()
    assert f.std_surge_multiplier == 0.0 and f.is_peak_hour == 0 and f.demand_index == 1.0
