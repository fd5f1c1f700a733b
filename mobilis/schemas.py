"""Schemas of feed and ride tables (the metric typing: ids are text)."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
          "timestamp_ntz": T.TimestampNTZType()}


def _schema(spec: str) -> T.StructType:
    """StructType from 'name type, ...' with simple types (no session needed)."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in spec.split(","))])


FEED_SCHEMAS: dict[str, T.StructType] = {
    "agency": _schema("agency_id string, agency_name string, agency_url string, agency_timezone string, "
                      "agency_lang string, agency_phone string, agency_fare_url string"),
    "calendar": _schema("service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, "
                        "saturday int, sunday int, start_date string, end_date string"),
    "routes": _schema("route_id string, agency_id string, route_short_name string, route_long_name string, "
                      "route_type int"),
    "trips": _schema("route_id string, service_id string, trip_id string, trip_headsign string, "
                     "direction_id int, shape_id string"),
    "stops": _schema("stop_id string, stop_code string, stop_name string, stop_lat double, stop_lon double, "
                     "zone_id string"),
    "stop_times": _schema("trip_id string, arrival_time string, departure_time string, stop_id string, "
                          "stop_sequence int"),
    "fare_attributes": _schema("fare_id string, price double, currency_type string, payment_method int, "
                               "transfers int, transfer_duration int, agency_id string"),
    "fare_rules": _schema("fare_id string, route_id string, origin_id string, destination_id string"),
    "shapes": _schema("shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int, "
                      "shape_dist_traveled double"),
    "feed_info": _schema("feed_publisher_name string, feed_publisher_url string, feed_lang string, "
                         "feed_start_date string, feed_end_date string, feed_version string, "
                         "feed_contact_email string, feed_contact_url string"),
    "translations": _schema("table_name string, field_name string, language string, translation string, "
                            "record_id string"),
}

RIDES_SCHEMA = _schema(
    "ride_id string, city string, timestamp timestamp_ntz, service string, vehicle_type string, "
    "start_lat double, start_lon double, end_lat double, end_lon double, distance_km double, "
    "duration_mins double, surge_multiplier double, fare double").add(
    "demand_features", _schema("hour_of_day int, day_of_week int, is_peak_hour int, is_weekend int"))

# FIXED VALUES: texts a CSV reader conventionally reads as missing (the
# common pandas default list), applied to every text column of a feed file.
NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
