"""DuckDB SQL for every registered query (the correctness oracle).

Each statement starts from the same WITH clause: the binding views over the
test tables, then the cleaned feed tables, the stop-event fact, the four
transit metrics and the prepared ride tables. Doubles are rounded to
``DIGITS`` decimals exactly where the Spark query rounds them.
"""

from __future__ import annotations

from mobilis import constants as K
from mobilis.plans import file_oracle
from mobilis.plans.common import DIGITS, NUDGE
from mobilis.sources.bindings import CITIES, oracle_with

D = DIGITS


def _peak(h: str, bands=K.PEAK_BANDS) -> str:
    return "(" + " OR ".join(f"({h} >= {lo} AND {h} <= {hi})" for lo, hi in bands) + ")"


_BASE = oracle_with() + f""",
routes_c AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY city, route_id
      ORDER BY route_short_name NULLS FIRST, route_long_name NULLS FIRST) AS rn
    FROM routes WHERE route_id IS NOT NULL) WHERE rn = 1),
trips_c AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY city, trip_id
      ORDER BY route_id NULLS FIRST, service_id NULLS FIRST) AS rn
    FROM trips WHERE trip_id IS NOT NULL) WHERE rn = 1),
stops_c AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY city, stop_id
      ORDER BY stop_name NULLS FIRST, stop_lat NULLS FIRST, stop_lon NULLS FIRST) AS rn
    FROM stops WHERE stop_id IS NOT NULL) WHERE rn = 1),
st_a AS (
  SELECT *, CASE WHEN regexp_full_match(arrival_time, '\\d{{1,2}}:\\d{{2}}:\\d{{2}}') THEN arrival_time
                 ELSE '00:00:00' END AS arrival_time_clean
  FROM stop_times WHERE trip_id IS NOT NULL AND stop_id IS NOT NULL AND arrival_time IS NOT NULL),
st_b AS (
  SELECT *, CAST(split_part(arrival_time_clean, ':', 1) AS INTEGER) AS arrival_hour,
            CAST(split_part(arrival_time_clean, ':', 2) AS INTEGER) AS arrival_minute,
            CAST(split_part(arrival_time_clean, ':', 3) AS INTEGER) AS arrival_second
  FROM st_a),
st_c AS (
  SELECT *, arrival_hour * 3600 + arrival_minute * 60 + arrival_second AS arrival_total_seconds FROM st_b),
fact AS (
  SELECT * FROM st_c JOIN trips_c USING (city, trip_id) JOIN routes_c USING (city, route_id)
  JOIN stops_c USING (city, stop_id)),
route_stats AS (
  SELECT city, route_id, route_short_name, route_long_name,
    count(DISTINCT trip_id) AS num_trips, count(DISTINCT stop_id) AS num_stops,
    count(*) AS total_stop_events, avg(arrival_hour) AS avg_service_hour,
    stddev_samp(arrival_hour) AS std_service_hour, count(DISTINCT service_id) AS num_services
  FROM fact GROUP BY city, route_id, route_short_name, route_long_name),
hourly_service AS (
  SELECT city, route_id, arrival_hour, count(*) AS hourly_stop_events,
    count(DISTINCT trip_id) AS hourly_trips, count(DISTINCT stop_id) AS hourly_stops
  FROM fact GROUP BY city, route_id, arrival_hour),
spatial_stats AS (
  SELECT * FROM (
    SELECT city, stop_id, stop_name, count(DISTINCT route_id) AS num_routes,
      count(DISTINCT trip_id) AS num_trips, count(*) AS total_events,
      avg(stop_lat) AS avg_lat, avg(stop_lon) AS avg_lon
    FROM fact GROUP BY city, stop_id, stop_name)
  WHERE avg_lat IS NOT NULL AND avg_lon IS NOT NULL),
headways AS (
  SELECT * FROM (
    SELECT *, arrival_total_seconds - prev_arrival AS headway_seconds FROM (
      SELECT *, lag(arrival_total_seconds) OVER (PARTITION BY city, route_id, stop_id
        ORDER BY arrival_total_seconds, trip_id, stop_sequence) AS prev_arrival
      FROM fact))
  WHERE headway_seconds IS NOT NULL AND headway_seconds > 0 AND headway_seconds < {K.HEADWAY_MAX_SECONDS}),
rides_t AS (
  SELECT *, CAST(hour("timestamp") AS INTEGER) AS hour,
    CAST(dayofweek("timestamp") + 1 AS INTEGER) AS day_of_week,
    CASE WHEN dayofweek("timestamp") IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN {_peak('hour("timestamp")')} THEN 1 ELSE 0 END AS is_peak_hour
  FROM rides),
rides_p AS (
  SELECT *, CASE WHEN distance_km = 0 THEN NULL ELSE fare / distance_km END AS fare_per_km,
    CASE WHEN duration_mins = 0 THEN NULL ELSE distance_km / (duration_mins / 60.0e0) END AS speed_kmh
  FROM rides_t
  WHERE distance_km > {K.RIDE_KM_RANGE[0]} AND distance_km < {K.RIDE_KM_RANGE[1]}
    AND fare > {K.RIDE_FARE_RANGE[0]} AND fare < {K.RIDE_FARE_RANGE[1]}
    AND duration_mins > {K.RIDE_MIN_RANGE[0]} AND duration_mins < {K.RIDE_MIN_RANGE[1]}),
ride_feat AS (
  SELECT ride_id, city, CAST(hour("timestamp") AS INTEGER) AS hour_of_day,
    CAST(dayofweek("timestamp") + 1 AS INTEGER) AS day_of_week,
    CASE WHEN dayofweek("timestamp") IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN {_peak('hour("timestamp")')} THEN 1 ELSE 0 END AS is_peak_hour,
    CASE WHEN distance_km > 0 THEN fare / distance_km ELSE fare END AS fare_per_km,
    fare, distance_km, duration_mins, surge_multiplier
  FROM rides WHERE hour("timestamp") IS NOT NULL),
ride_features AS (
  SELECT city, hour_of_day, is_weekend,
    coalesce(avg(fare), 0.0e0) AS avg_fare, coalesce(avg(fare_per_km), 0.0e0) AS avg_price_per_km,
    avg(surge_multiplier) AS avg_surge_multiplier,
    coalesce(stddev_samp(surge_multiplier), 0.0e0) AS std_surge_multiplier,
    count(*) AS ride_count, coalesce(avg(distance_km), 0.0e0) AS avg_distance_km,
    coalesce(avg(duration_mins), 0.0e0) AS avg_duration_mins
  FROM ride_feat GROUP BY city, hour_of_day, is_weekend),
modeling AS (
  SELECT *, CASE WHEN {_peak('hour_of_day')} THEN 1 ELSE 0 END AS is_peak_hour,
    CASE WHEN {_peak('hour_of_day')} THEN ride_count * {K.PEAK_DEMAND_WEIGHT}e0 ELSE CAST(ride_count AS DOUBLE) END
      AS demand_index
  FROM ride_features)
"""


def q(body: str) -> str:
    return _BASE + body


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- cleaning
SQL["clean_routes"] = q("SELECT city, route_id, route_short_name, route_long_name FROM routes_c")
SQL["clean_trips"] = q("SELECT city, trip_id, route_id, service_id FROM trips_c")
SQL["clean_stops"] = q(f"SELECT city, stop_id, stop_name, round(stop_lat, {D}) AS stop_lat, "
                       f"round(stop_lon, {D}) AS stop_lon FROM stops_c")
SQL["clean_stop_times"] = q("SELECT city, trip_id, stop_id, stop_sequence, arrival_time FROM st_a")
SQL["parse_service_time"] = q(
    "SELECT city, trip_id, stop_id, stop_sequence, arrival_time, arrival_time_clean, arrival_hour, "
    "arrival_minute, arrival_second, arrival_total_seconds FROM st_c")

# ---------------------------------------------------------------- joins / metrics
SQL["trip_stop_events"] = q(
    f"SELECT city, trip_id, stop_id, stop_sequence, arrival_time, arrival_hour, arrival_total_seconds, "
    f"route_id, service_id, route_short_name, route_long_name, stop_name, "
    f"round(stop_lat, {D}) AS stop_lat, round(stop_lon, {D}) AS stop_lon FROM fact")
SQL["route_stats"] = q(
    f"SELECT city, route_id, route_short_name, route_long_name, num_trips, num_stops, total_stop_events, "
    f"round(avg_service_hour, {D}) AS avg_service_hour, round(std_service_hour, {D}) AS std_service_hour, "
    f"num_services FROM route_stats")
SQL["hourly_service"] = q("SELECT * FROM hourly_service")
SQL["spatial_stats"] = q(
    f"SELECT city, stop_id, stop_name, num_routes, num_trips, total_events, round(avg_lat, {D}) AS avg_lat, "
    f"round(avg_lon, {D}) AS avg_lon FROM spatial_stats")
SQL["headways"] = q(
    "SELECT city, route_id, stop_id, trip_id, stop_sequence, arrival_time, arrival_hour, "
    "arrival_total_seconds, service_id, prev_arrival, headway_seconds FROM headways")


# ---------------------------------------------------------------- summaries
_LABEL = ("coalesce(CASE WHEN trim(CAST(route_long_name AS VARCHAR)) <> '' THEN CAST(route_long_name AS VARCHAR) END, "
          "CASE WHEN trim(CAST(route_short_name AS VARCHAR)) <> '' THEN CAST(route_short_name AS VARCHAR) END, "
          "CAST(route_id AS VARCHAR))")
_NAME = ("coalesce(CASE WHEN CAST(route_long_name AS VARCHAR) <> '' THEN CAST(route_long_name AS VARCHAR) END, "
         "CASE WHEN CAST(route_short_name AS VARCHAR) <> '' THEN CAST(route_short_name AS VARCHAR) END, "
         "'Route ' || CAST(route_id AS VARCHAR))")

_SUMS = f""",
rsum AS (
  SELECT city, count(*) AS total_routes, avg(num_trips) AS avg_trips_per_route,
    CAST(quantile_cont(num_trips, 0.5) AS DOUBLE) AS median_trips_per_route,
    avg(num_stops) AS avg_stops_per_route, CAST(sum(total_stop_events) AS BIGINT) AS total_stop_events,
    first(route_id ORDER BY num_trips DESC, route_id) AS busiest_route_id, max(num_trips) AS busiest_route_trips,
    count_if(num_trips > {K.HIGH_FREQUENCY_TRIPS}) AS high_frequency,
    count_if(num_trips >= {K.LOW_FREQUENCY_TRIPS} AND num_trips <= {K.HIGH_FREQUENCY_TRIPS}) AS medium_frequency,
    count_if(num_trips < {K.LOW_FREQUENCY_TRIPS}) AS low_frequency
  FROM route_stats GROUP BY city),
hmin AS (SELECT city, CAST(headway_seconds AS DOUBLE) / 60.0e0 AS m FROM headways),
hsum AS (
  SELECT city, avg(m) AS avg_headway_min, quantile_cont(m, 0.5) AS median_headway_min,
    stddev_samp(m) AS std_headway_min, min(m) AS min_headway_min, max(m) AS max_headway_min,
    quantile_cont(m, 0.95) AS p95_headway_min, quantile_cont(m, 0.05) AS p05_headway_min,
    count(*) AS total_headways_analyzed,
    count_if(m <= {K.ON_TIME_HEADWAY_MIN}) / count(*) * 100 AS on_time_percentage,
    count_if(m <= {K.HIGH_FREQ_HEADWAY_MIN}) / count(*) * 100 AS high_frequency_percentage
  FROM hmin GROUP BY city),
hp AS (
  SELECT city, arrival_hour, CAST(sum(hourly_trips) AS BIGINT) AS hourly_trips,
    CAST(sum(hourly_stop_events) AS BIGINT) AS hourly_stop_events
  FROM hourly_service GROUP BY city, arrival_hour),
sprof AS (
  SELECT city, first(arrival_hour ORDER BY hourly_trips DESC, arrival_hour) AS peak_hour,
    max(hourly_trips) AS peak_hour_trips, first(arrival_hour ORDER BY hourly_trips, arrival_hour) AS off_peak_hour,
    count(DISTINCT arrival_hour) AS total_service_hours,
    CAST(24 - count(DISTINCT arrival_hour) FILTER (WHERE hourly_trips > 0 AND arrival_hour BETWEEN 0 AND 23)
         AS INTEGER) AS n_service_gaps
  FROM hp GROUP BY city),
ssum AS (
  SELECT city, count(*) AS total_stops_analyzed, avg(num_routes) AS avg_routes_per_stop,
    max(num_routes) AS max_routes_per_stop, count_if(num_routes >= {K.HUB_MIN_ROUTES}) AS major_hubs,
    min(avg_lat) AS lat_min, max(avg_lat) AS lat_max, min(avg_lon) AS lon_min, max(avg_lon) AS lon_max
  FROM spatial_stats GROUP BY city),
assess AS (
  SELECT city, 0 AS overall_score,
    concat_ws('|',
      CASE WHEN total_routes IS NOT NULL AND avg_trips_per_route > {K.STRENGTH_TRIPS_PER_ROUTE}
           THEN '{K.TEXT_HIGH_FREQUENCY}' END,
      CASE WHEN avg_headway_min < {K.STRENGTH_HEADWAY_MIN} THEN '{K.TEXT_GOOD_HEADWAY}' END) AS key_strengths,
    concat_ws('|',
      CASE WHEN total_routes IS NOT NULL AND NOT coalesce(avg_trips_per_route > {K.STRENGTH_TRIPS_PER_ROUTE}, false)
           THEN '{K.TEXT_RAISE_FREQUENCY}' END,
      CASE WHEN NOT coalesce(avg_headway_min < {K.STRENGTH_HEADWAY_MIN}, false)
           THEN '{K.TEXT_IMPROVE_HEADWAY}' END) AS improvement_areas,
    total_routes, total_stop_events AS total_trips_estimate
  FROM (SELECT city, total_routes, avg_trips_per_route, total_stop_events FROM rsum)
  FULL OUTER JOIN (SELECT city, avg_headway_min FROM hsum) USING (city)),
freq AS (SELECT city, arrival_hour, count(*) AS n FROM hourly_service GROUP BY city, arrival_hour),
hmode AS (SELECT city, first(arrival_hour ORDER BY n DESC, arrival_hour) AS arrival_hour FROM freq GROUP BY city),
at_peak AS (
  SELECT city, route_id, CAST(sum(hourly_trips) AS BIGINT) AS hourly_trips
  FROM hourly_service JOIN hmode USING (city, arrival_hour) GROUP BY city, route_id),
ra AS (
  SELECT *, hourly_trips / num_stops AS service_intensity FROM route_stats LEFT JOIN at_peak USING (city, route_id)),
med AS (
  SELECT city, quantile_cont(num_stops, 0.5) AS ms, quantile_cont(service_intensity, 0.5) AS mi
  FROM ra GROUP BY city),
gap AS (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY num_stops DESC, route_id) AS rank
  FROM ra JOIN med USING (city) WHERE num_stops > ms AND service_intensity < mi)
"""


def qs(body: str) -> str:
    return _BASE + _SUMS + body


def _r(cols: str) -> str:
    return ", ".join(f"round({c}, {D}) AS {c}" for c in cols.split())


SQL["route_summary"] = qs(
    f"SELECT city, total_routes, {_r('avg_trips_per_route median_trips_per_route avg_stops_per_route')}, "
    f"total_stop_events, busiest_route_id, busiest_route_trips, high_frequency, medium_frequency, "
    f"low_frequency FROM rsum")
SQL["headway_summary"] = qs(
    f"SELECT city, {_r('avg_headway_min median_headway_min std_headway_min min_headway_min max_headway_min')}, "
    f"{_r('p95_headway_min p05_headway_min')}, total_headways_analyzed, "
    f"{_r('on_time_percentage high_frequency_percentage')} FROM hsum")
SQL["service_profile"] = qs("SELECT * FROM sprof")
SQL["hourly_profile_series"] = qs("SELECT * FROM hp")
SQL["service_gaps"] = qs(
    "SELECT c.city, CAST(t.hour AS INTEGER) AS hour FROM (SELECT DISTINCT city FROM hourly_service) c "
    "CROSS JOIN range(0, 24) t(hour) WHERE NOT EXISTS (SELECT 1 FROM hp WHERE hp.city = c.city "
    "AND hp.arrival_hour = t.hour AND hp.hourly_trips > 0)")
SQL["stop_summary"] = qs(
    f"SELECT city, total_stops_analyzed, {_r('avg_routes_per_stop')}, max_routes_per_stop, major_hubs, "
    f"{_r('lat_min lat_max lon_min lon_max')} FROM ssum")
SQL["city_assessment"] = qs("SELECT * FROM assess")
SQL["city_analysis"] = qs(
    f"SELECT city, total_routes, {_r('avg_trips_per_route median_trips_per_route avg_stops_per_route')}, "
    f"total_stop_events, busiest_route_id, busiest_route_trips, high_frequency, medium_frequency, low_frequency, "
    f"{_r('avg_headway_min median_headway_min std_headway_min min_headway_min max_headway_min')}, "
    f"{_r('p95_headway_min p05_headway_min')}, total_headways_analyzed, "
    f"{_r('on_time_percentage high_frequency_percentage')}, "
    f"peak_hour, peak_hour_trips, off_peak_hour, total_service_hours, n_service_gaps, "
    f"total_stops_analyzed, {_r('avg_routes_per_stop')}, max_routes_per_stop, major_hubs, "
    f"{_r('lat_min lat_max lon_min lon_max')}, overall_score, key_strengths, improvement_areas, "
    f"total_trips_estimate "
    f"FROM rsum FULL JOIN hsum USING (city) FULL JOIN sprof USING (city) FULL JOIN ssum USING (city) "
    f"FULL JOIN (SELECT * EXCLUDE (total_routes) FROM assess) USING (city)")
SQL["transit_city_comparison"] = qs(
    f"SELECT city, coalesce(routes, 0) AS routes, round(coalesce(avg_headway_min, 0.0), {D}) AS avg_headway_min, "
    f"coalesce(stops, 0) AS stops, coalesce(peak_hour_trips, 0) AS peak_hour_trips FROM "
    f"(SELECT city, count(*) AS routes FROM route_stats GROUP BY city) "
    f"FULL JOIN (SELECT city, avg(headway_seconds) / 60 AS avg_headway_min FROM headways GROUP BY city) USING (city) "
    f"FULL JOIN (SELECT city, count(*) AS stops FROM spatial_stats GROUP BY city) USING (city) "
    f"FULL JOIN (SELECT city, max(hourly_trips) AS peak_hour_trips FROM hourly_service GROUP BY city) USING (city)")
SQL["record_count_comparison"] = qs("SELECT city, count(*) AS records FROM fact GROUP BY city")
SQL["total_routes_rollup"] = qs(
    "SELECT CAST(sum(coalesce(total_routes, 0)) AS BIGINT) AS total_routes, count(*) AS cities FROM assess")
SQL["route_frequency_mix"] = qs(
    f"SELECT city, bucket, count(*) AS routes, round(count(*) / any_value(n) * 100, {D}) AS share_pct FROM ("
    f"SELECT city, CASE WHEN num_trips < {K.LOW_FREQUENCY_TRIPS} THEN 'low' "
    f"WHEN num_trips <= {K.HIGH_FREQUENCY_TRIPS} THEN 'medium' ELSE 'high' END AS bucket, "
    f"count(*) OVER (PARTITION BY city) AS n FROM route_stats) GROUP BY city, bucket")

# ---------------------------------------------------------------- top-k
def _topk(src: str, order: str, k: int, cols: str) -> str:
    return qs(f"SELECT {cols} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY city ORDER BY {order}) "
              f"AS INTEGER) AS rank FROM {src}) WHERE rank <= {k}")


SQL["busiest_routes"] = _topk("route_stats", "num_trips DESC, route_id", 20,
                              f"city, rank, route_id, {_NAME} AS route_name, num_trips")
SQL["top_routes"] = _topk("route_stats", "num_trips DESC, route_id", 10,
                          f"city, rank, route_id, {_LABEL} AS route_label, num_trips")
SQL["least_used_routes"] = _topk("route_stats", "num_trips, route_id", 10,
                                 f"city, rank, route_id, {_LABEL} AS route_label, num_trips")
SQL["transfer_points"] = _topk("spatial_stats", "num_routes DESC, stop_id", 10,
                               "city, rank, stop_id, substring(stop_name, 1, 20) AS stop_label, num_routes")
SQL["busiest_route"] = qs("SELECT city, busiest_route_id AS route_id, busiest_route_trips AS num_trips FROM rsum")
SQL["peak_hour"] = qs("SELECT city, peak_hour, peak_hour_trips, off_peak_hour FROM sprof")
SQL["demand_service_gap"] = qs(
    f"SELECT city, CAST(rank AS INTEGER) AS rank, route_id, {_LABEL} AS route_label, num_stops, num_trips, "
    f"hourly_trips, round(service_intensity, {D}) AS service_intensity FROM gap WHERE rank <= 10")
SQL["underserved_vs_average"] = qs(
    f"SELECT city, round(u, {D}) AS underserved_intensity, round(a, {D}) AS city_average_intensity FROM "
    f"(SELECT city, avg(service_intensity) AS u FROM gap WHERE rank <= 5 GROUP BY city) "
    f"JOIN (SELECT city, avg(service_intensity) AS a FROM ra GROUP BY city) USING (city)")
SQL["route_label"] = qs(f"SELECT city, route_id, {_LABEL} AS route_label FROM route_stats")
SQL["route_name_map"] = qs(f"SELECT city, route_id, {_NAME} AS route_name FROM routes_c")
SQL["stop_label"] = qs("SELECT city, stop_id, substring(stop_name, 1, 20) AS stop_label FROM spatial_stats")


# ---------------------------------------------------------------- rides
SQL["ride_time_features"] = q("SELECT ride_id, city, hour, day_of_week, is_weekend, is_peak_hour FROM rides_t")
SQL["ride_ratios"] = q(
    f"SELECT ride_id, {_r('fare_per_km speed_kmh')} FROM (SELECT ride_id, "
    f"CASE WHEN distance_km = 0 THEN NULL ELSE fare / distance_km END AS fare_per_km, "
    f"CASE WHEN duration_mins = 0 THEN NULL ELSE distance_km / (duration_mins / 60.0e0) END AS speed_kmh "
    f"FROM rides)")
SQL["ride_outlier_filter"] = q(
    f"SELECT ride_id, city, service, {_r('distance_km fare duration_mins fare_per_km speed_kmh')} FROM rides_p")
SQL["ride_feature_columns"] = q(
    f"SELECT ride_id, city, hour_of_day, day_of_week, is_weekend, is_peak_hour, {_r('fare_per_km')} FROM ride_feat")
SQL["ride_default_columns"] = q(
    f"SELECT ride_id, round(fare, {D}) AS fare, 0.0e0 AS duration_mins, 1.0e0 AS surge_multiplier FROM rides")
SQL["typed_or_string"] = q(
    "SELECT city, CAST(trip_id AS VARCHAR) AS trip_id, CAST(stop_id AS VARCHAR) AS stop_id, "
    "stop_sequence, arrival_time FROM stop_times")
SQL["ride_price_by_type"] = q(
    f"SELECT city, service, vehicle_type, round(avg(fare), {D}) AS avg_fare, "
    f"round(avg(fare_per_km), {D}) AS avg_fare_per_km, round(avg(surge_multiplier), {D}) AS avg_surge, "
    f"count(*) AS ride_count FROM rides_p GROUP BY city, service, vehicle_type")
SQL["ride_distance_by_type"] = q(
    f"SELECT city, service, vehicle_type, round(avg(distance_km), {D}) AS avg_distance, "
    f"round(avg(duration_mins), {D}) AS avg_duration, round(stddev_samp(distance_km), {D}) AS std_distance "
    f"FROM rides_p GROUP BY city, service, vehicle_type")
SQL["service_popularity"] = q(
    f"SELECT city, service, count(*) AS total_rides, round(avg(fare), {D}) AS avg_fare "
    f"FROM rides_p GROUP BY city, service")
SQL["hourly_surge"] = q(
    f"SELECT city, hour, service, round(avg(surge_multiplier), {D}) AS avg_surge FROM rides_p "
    f"GROUP BY city, hour, service")


def _split(flag: str, on: str, off: str) -> str:
    return q(f"SELECT city, service, round(avg(surge_multiplier) FILTER (WHERE {flag} = 1), {D}) AS {on}, "
             f"round(avg(surge_multiplier) FILTER (WHERE {flag} = 0), {D}) AS {off} FROM rides_p "
             f"GROUP BY city, service HAVING count_if({flag} = 1) > 0 AND count_if({flag} = 0) > 0")


SQL["peak_vs_offpeak"] = _split("is_peak_hour", "avg_peak_surge", "avg_non_peak_surge")
SQL["weekend_vs_weekday"] = _split("is_weekend", "avg_weekend_surge", "avg_weekday_surge")
SQL["ride_comparison_projection"] = q(
    f"SELECT city, service, vehicle_type, {_r('fare distance_km duration_mins surge_multiplier')}, hour, "
    f"is_weekend FROM rides_p")
_FEAT = ("avg_fare avg_price_per_km avg_surge_multiplier std_surge_multiplier avg_distance_km "
         "avg_duration_mins")
SQL["ride_features"] = q(f"SELECT city, hour_of_day, is_weekend, {_r(_FEAT)}, ride_count FROM ride_features")
SQL["union_cities"] = SQL["ride_features"]
SQL["fill_feature_nulls"] = q(
    f"SELECT city, hour_of_day, is_weekend, "
    f"{_r('std_surge_multiplier avg_price_per_km avg_fare avg_distance_km avg_duration_mins')} FROM ride_features")
SQL["modeling_dataset"] = q(
    f"SELECT city, hour_of_day, is_weekend, {_r(_FEAT)}, ride_count, is_peak_hour, {_r('demand_index')} "
    f"FROM modeling")
SQL["demand_index"] = q(
    f"SELECT city, hour_of_day, is_weekend, ride_count, is_peak_hour, {_r('demand_index')} FROM modeling")
SQL["concat_tagged"] = q(f"SELECT service, {_r('fare distance_km surge_multiplier')}, city FROM rides")
SQL["simple_ride_dataset"] = q(
    f"SELECT {_r('surge_multiplier')}, hour_of_day, is_weekend, is_peak_hour, "
    f"{_r('fare distance_km duration_mins fare_per_km')}, city FROM ride_feat")
SQL["surge_label"] = q(
    f"SELECT city, hour_of_day, is_weekend, {_r('avg_surge_multiplier')}, "
    f"CASE WHEN avg_surge_multiplier > {K.HIGH_SURGE_THRESHOLD}e0 THEN 1 ELSE 0 END AS high_surge, "
    f"CASE WHEN avg_surge_multiplier > {K.HIGH_SURGE_THRESHOLD}e0 THEN 1.0e0 ELSE 0.0e0 END AS label FROM modeling")
_CITY_STATS = (
    f"SELECT city, count(*) AS total_rides, round(avg(fare), {D}) AS avg_fare, "
    f"round(avg(distance_km), {D}) AS avg_distance, round(avg(duration_mins), {D}) AS avg_duration, "
    f"round(avg(surge_multiplier), {D}) AS avg_surge, count(DISTINCT service) AS services, "
    f"count(DISTINCT vehicle_type) AS vehicle_types FROM rides GROUP BY city")
SQL["city_ride_stats"] = q(_CITY_STATS)
SQL["ride_count_check"] = q("SELECT city, count(*) AS rides FROM rides GROUP BY city")


def _pricing() -> str:
    cols, having = [], []
    for c in CITIES:
        cols.append(f"round(avg(fare) FILTER (WHERE city = '{c}'), {D}) AS {c}_avg_fare")
        cols.append(f"round(avg(CASE WHEN distance_km = 0 THEN NULL ELSE fare / distance_km END) "
                    f"FILTER (WHERE city = '{c}'), {D}) AS {c}_fare_per_km")
        having.append(f"count(*) FILTER (WHERE city = '{c}') > 0")
    return f"SELECT service, {', '.join(cols)} FROM rides GROUP BY service HAVING {' AND '.join(having)}"


# Every service of the rides view; "metro" has no tariff.
SERVICES = ["metro", *dict.fromkeys(t[0] for t in K.TARIFF)]
SQL["cross_city_pricing"] = q(_pricing())
SQL["fare_pivot"] = q(
    "SELECT city, " + ", ".join(f"round(avg(fare) FILTER (WHERE service = '{v}'), {D}) AS {v}" for v in SERVICES)
    + " FROM rides GROUP BY city")
SQL["service_mix_pivot"] = q(
    "SELECT city, " + ", ".join(f"nullif(count(*) FILTER (WHERE service = '{v}'), 0) AS {v}" for v in SERVICES)
    + " FROM rides GROUP BY city")
SQL["fare_distance_points"] = q(f"SELECT city, service, {_r('distance_km fare')} FROM rides")
_BUCKET = ("CAST(('0x' || substr(md5('42|' || city || '|' || CAST(hour_of_day AS VARCHAR) || '|' || "
           "CAST(is_weekend AS VARCHAR)), 1, 8)) AS BIGINT) % 1000")
SQL["split_data"] = q(f"SELECT city, hour_of_day, is_weekend, CASE WHEN {_BUCKET} < 800 THEN 'train' ELSE 'test' END AS split FROM modeling")
SQL["model_city_summary"] = q(
    f"SELECT city, round(avg(avg_surge_multiplier), {D}) AS avg_surge_multiplier, "
    f"CAST(sum(ride_count) AS BIGINT) AS ride_count FROM modeling GROUP BY city")
SQL["ride_comparison"] = q(
    f"SELECT s.*, p.shared_services FROM ({_CITY_STATS}) s CROSS JOIN "
    f"(SELECT count(*) AS shared_services FROM ({_pricing()})) p")


# ---------------------------------------------------------------- scoring
def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    return f"({K.EARTH_RADIUS_KM}e0 * (2 * atan2(sqrt({a}), sqrt(1 - {a}))))"


def _lit(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


_HOUR = 'hour("timestamp")'
_WD = '(isodow("timestamp") - 1)'
_BAND = (f"CASE WHEN {_peak(_HOUR)} THEN {_lit(K.PEAK_SURGE)} "
         f"WHEN {_HOUR} >= {K.LUNCH_BAND[0]} AND {_HOUR} <= {K.LUNCH_BAND[1]} THEN {_lit(K.LUNCH_SURGE)} "
         f"WHEN {_HOUR} >= {K.LATE_NIGHT_FROM} OR {_HOUR} <= {K.LATE_NIGHT_TO} THEN {_lit(K.LATE_NIGHT_SURGE)} "
         f"ELSE 0.0e0 END")
_WEEKEND = (f"CASE WHEN {_WD} >= 5 THEN {_lit(K.WEEKEND_SURGE)} WHEN {_WD} = 4 AND {_HOUR} >= "
            f"{K.FRIDAY_EVENING_FROM} THEN {_lit(K.FRIDAY_EVENING_SURGE)} ELSE 0.0e0 END")
_SEASON = (f"CASE WHEN month(\"timestamp\") BETWEEN {K.MONSOON_MONTHS[0]} AND {K.MONSOON_MONTHS[1]} "
           f"THEN {_lit(K.MONSOON_SURGE)} ELSE 0.0e0 END")
_AREAS = ", ".join(f"('{c}', {_lit(a)}, {_lit(o)}, {_lit(r)}, {_lit(m)})" for c, a, o, r, m in K.SURGE_AREAS)
_FEST = ", ".join(f"({m}, {d}, {_lit(add)})" for m, days, add in K.FESTIVAL_DATES for d in days)
_CMON = ", ".join(f"('{c}', {m}, {_lit(add)})" for c, m, add in K.CITY_MONTH_SURGE)
_TARIFF = ", ".join(f"('{s_}', '{v}', {_lit(b)}, {_lit(k)}, {_lit(mi)}, {_lit(f)})"
                    for s_, v, b, k, mi, f in K.TARIFF)

_SCORE = f""",
areas AS (SELECT * FROM (VALUES {_AREAS}) t(a_city, a_lat, a_lon, a_radius, a_mult)),
fest AS (SELECT * FROM (VALUES {_FEST}) t(f_month, f_day, festival_surge)),
cmon AS (SELECT * FROM (VALUES {_CMON}) t(cm_city, cm_month, city_month_surge)),
tariff AS (SELECT * FROM (VALUES {_TARIFF}) t(t_service, t_vehicle, base, per_km, per_min, booking_fee)),
area_s AS (
  SELECT ride_id, coalesce(sum(CASE WHEN d <= a_radius THEN a_mult * (1.0e0 - d / a_radius) ELSE 0.0e0 END), 0.0e0)
    AS area_surge
  FROM (SELECT r.ride_id, a.a_radius, a.a_mult, {_hav('r.start_lat', 'r.start_lon', 'a.a_lat', 'a.a_lon')} AS d
        FROM rides r LEFT JOIN areas a ON r.city = a.a_city)
  GROUP BY ride_id),
cal_s AS (
  SELECT r.ride_id, coalesce(f.festival_surge, 0.0e0) + coalesce(c.city_month_surge, 0.0e0) AS calendar_surge
  FROM rides r
  LEFT JOIN fest f ON month(r."timestamp") = f.f_month AND day(r."timestamp") = f.f_day
  LEFT JOIN cmon c ON r.city = c.cm_city AND month(r."timestamp") = c.cm_month),
parts AS (
  SELECT r.ride_id, {_BAND} AS time_band_surge, {_WEEKEND} AS weekend_surge, {_SEASON} AS season_surge,
    cal_s.calendar_surge, area_s.area_surge
  FROM rides r JOIN cal_s USING (ride_id) JOIN area_s USING (ride_id))
"""


def qsc(body: str) -> str:
    return _BASE + _SCORE + body


SQL["haversine_km"] = q(f"SELECT ride_id, round({_hav('start_lat', 'start_lon', 'end_lat', 'end_lon')}, {D}) "
                        f"AS straight_km FROM rides")
SQL["estimated_duration"] = q(
    f"SELECT ride_id, round_even(greatest({_lit(K.MIN_TRIP_MINUTES)}, "
    f"{_hav('start_lat', 'start_lon', 'end_lat', 'end_lon')} / {_lit(K.URBAN_SPEED_KMH)} * 60.0e0 * 1.5e0), 0) "
    f"AS est_duration_mins FROM rides")
SQL["time_band_surge"] = q(f"SELECT ride_id, {_BAND} AS time_band_surge FROM rides")
SQL["weekend_surge"] = q(f"SELECT ride_id, {_WEEKEND} AS weekend_surge FROM rides")
SQL["season_surge"] = q(f"SELECT ride_id, {_SEASON} AS season_surge FROM rides")
SQL["area_surge"] = qsc(f"SELECT ride_id, round(area_surge, {D}) AS area_surge FROM area_s")
SQL["calendar_surge"] = qsc(f"SELECT ride_id, round(calendar_surge, {D}) AS calendar_surge FROM cal_s")
SQL["surge_multiplier"] = qsc(
    f"SELECT ride_id, round(greatest({_lit(K.SURGE_MIN)}, least({_lit(K.SURGE_MAX)}, 1.0e0 + time_band_surge "
    f"+ weekend_surge + calendar_surge + area_surge + season_surge)), {D}) AS surge_score FROM parts")
SQL["tariff_fare"] = qsc(
    f"SELECT ride_id, service, vehicle_type, round(CASE WHEN t_service IS NULL THEN 0.0e0 ELSE "
    f"round_even((base + per_km * distance_km + per_min * duration_mins + booking_fee) * surge_multiplier / 10, 0) "
    f"* 10 END, {D}) AS tariff_fare FROM rides LEFT JOIN tariff ON service = t_service AND vehicle_type = t_vehicle")
_RP = _peak(_HOUR, K.RECORD_PEAK_BANDS)
SQL["ride_demand_struct"] = q(
    f"SELECT ride_id, CAST({_HOUR} AS INTEGER) AS hour_of_day, CAST({_WD} AS INTEGER) AS day_of_week, "
    f"CASE WHEN {_RP} THEN 1 ELSE 0 END AS is_peak_hour, CASE WHEN {_WD} >= 5 THEN 1 ELSE 0 END AS is_weekend "
    f"FROM rides")


# ---------------------------------------------------------------- profile
from mobilis.sources.bindings import PROFILE_NUMERIC, PROFILE_TEXT, PROFILE_VIEWS, PROFILE_WIDTH  # noqa: E402


def _qcol(c: str) -> str:
    return f'"{c}"'


def _union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


SQL["profile_table"] = q(_union_all([
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, {PROFILE_WIDTH[t]} AS n_columns, "
    f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicates FROM {t}"
    for t in PROFILE_VIEWS]))
SQL["table_size_comparison"] = q(_union_all([
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, {PROFILE_WIDTH[t]} AS n_columns FROM {t}"
    for t in PROFILE_VIEWS]))


def _num(c: str) -> str:
    return f"CAST({_qcol(c)} AS DOUBLE)"


SQL["numeric_stats"] = q(_union_all([
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({_num(c)}) AS n, "
    f"round(avg({_num(c)}), {D}) AS mean, round(stddev_samp({_num(c)}), {D}) AS std, "
    f"round(min({_num(c)}), {D}) AS min_value, round(quantile_cont({_num(c)}, 0.25), {D}) AS q25, "
    f"round(quantile_cont({_num(c)}, 0.5), {D}) AS q50, round(quantile_cont({_num(c)}, 0.75), {D}) AS q75, "
    f"round(max({_num(c)}), {D}) AS max_value FROM {t}"
    for t in PROFILE_VIEWS for c in PROFILE_NUMERIC[t]]))

_ALL_COLS = {
    "stop_times": ["city", "trip_id", "stop_id", "stop_sequence", "arrival_time"],
    "trips": ["city", "trip_id", "route_id", "service_id"],
    "routes": ["city", "route_id", "route_short_name", "route_long_name"],
    "stops": ["city", "stop_id", "stop_name", "stop_lat", "stop_lon"],
    "accounts": ["account_id", "segment", "balance"],
    "rides": ["ride_id", "city", "timestamp", "service", "vehicle_type", "start_lat", "start_lon", "end_lat",
              "end_lon", "distance_km", "duration_mins", "surge_multiplier", "fare"],
}


def _miss(t: str, c: str) -> str:
    floating = c in PROFILE_NUMERIC[t] and c not in ("trip_id", "stop_id", "stop_sequence", "route_id", "ride_id")
    test = f"{_qcol(c)} IS NULL" + (f" OR isnan({_qcol(c)})" if floating else "")
    return (f"SELECT '{t}' AS table_name, '{c}' AS column_name, count_if({test}) AS missing, "
            f"round(count_if({test}) / count(*) * 100, {D}) AS missing_pct FROM {t}")


SQL["missing_values"] = q(f"SELECT * FROM ({_union_all([_miss(t, c) for t in PROFILE_VIEWS for c in _ALL_COLS[t]])}) "
                          f"WHERE missing > 0")


def _issues(t: str, c: str) -> list[str]:
    v = _num(c)
    fence = (f"(SELECT q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM "
             f"(SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {t}))")
    zero_ok = "false" if c.lower() in K.WEEKDAY_COLUMNS else "true"
    return [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'negative_values' AS issue, count_if({v} < 0) AS count "
        f"FROM {t}",
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'zero_values' AS issue, "
        f"count_if({v} = 0 AND {zero_ok}) AS count FROM {t}",
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'outliers' AS issue, "
        f"count_if({v} < f.lo OR {v} > f.hi) AS count FROM {t}, {fence} f",
    ]


_ISSUES = _union_all([p for t in PROFILE_VIEWS for c in PROFILE_NUMERIC[t] for p in _issues(t, c)])
for _key, _name in [("quality_negative", "negative_values"), ("quality_zero", "zero_values"),
                    ("quality_outliers", "outliers")]:
    SQL[_key] = q(f"SELECT * FROM ({_ISSUES}) WHERE count > 0 AND issue = '{_name}'")

SQL["quality_issue_matrix"] = q(
    f"SELECT table_name, CAST(sum(count) FILTER (WHERE issue = 'negative_values') AS BIGINT) AS negative_values, "
    f"CAST(sum(count) FILTER (WHERE issue = 'zero_values') AS BIGINT) AS zero_values, "
    f"CAST(sum(count) FILTER (WHERE issue = 'outliers') AS BIGINT) AS outliers "
    f"FROM ({_ISSUES}) WHERE count > 0 GROUP BY table_name")
SQL["top_categories"] = q(
    "SELECT table_name, column_name, value, count, CAST(rank AS INTEGER) AS rank FROM ("
    "SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY count DESC, value) AS rank FROM ("
    + _union_all([f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({_qcol(c)} AS VARCHAR) AS value, "
                  f"count(*) AS count FROM {t} WHERE {_qcol(c)} IS NOT NULL GROUP BY {_qcol(c)}"
                  for t in PROFILE_VIEWS for c in PROFILE_TEXT[t]])
    + ")) WHERE rank <= 10")


# ---------------------------------------------------------------- distributions
def _hist(src: str, bins: int, cdf: bool = False) -> str:
    """numpy-rule histogram of ``src`` (columns city, v) with every bin listed."""
    edge = (lambda i: f"(CASE WHEN ({i}) >= {bins} THEN _hi ELSE ({i}) * _step + _lo END)")
    i1 = f"least(CAST(floor((v - _lo) * (CAST({bins} AS DOUBLE) / (_hi - _lo))) AS INTEGER), {bins - 1})"
    body = (
        f"SELECT city, bin, round({edge('bin')}, {D}) AS bin_start, round({edge('bin + 1')}, {D}) AS bin_end, "
        f"coalesce(cnt, 0) AS count FROM ("
        f"SELECT city, _lo, _hi, _step, CAST(b.bin AS INTEGER) AS bin FROM rng CROSS JOIN range(0, {bins}) b(bin)) g "
        f"LEFT JOIN (SELECT city, CASE WHEN v < {edge('i1')} THEN i1 - 1 "
        f"WHEN v >= {edge('i1 + 1')} AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS bin, count(*) AS cnt "
        f"FROM (SELECT city, v, _lo, _hi, _step, {i1} AS i1 FROM data JOIN rng USING (city)) GROUP BY ALL) c "
        f"USING (city, bin)")
    rng = ("SELECT city, CASE WHEN mn = mx THEN mn - 0.5e0 ELSE mn END AS _lo, "
           "CASE WHEN mn = mx THEN mx + 0.5e0 ELSE mx END AS _hi, "
           f"(CASE WHEN mn = mx THEN mx + 0.5e0 ELSE mx END - CASE WHEN mn = mx THEN mn - 0.5e0 ELSE mn END) "
           f"/ CAST({bins} AS DOUBLE) AS _step "
           "FROM (SELECT city, min(v) AS mn, max(v) AS mx FROM data GROUP BY city)")
    sql = qs(f", data AS ({src}), rng AS ({rng}), hist AS ({body}) ")
    if cdf:
        return sql + (f"SELECT *, round(sum(count) OVER (PARTITION BY city ORDER BY bin ROWS BETWEEN UNBOUNDED "
                      f"PRECEDING AND CURRENT ROW) / sum(count) OVER (PARTITION BY city), {D}) AS cumulative_share "
                      f"FROM hist")
    return sql + "SELECT * FROM hist"


_HW = "SELECT city, v FROM (SELECT city, CAST(headway_seconds AS DOUBLE) / 60.0e0 AS v FROM headways) WHERE v < 60.0e0"
SQL["trips_histogram"] = _hist("SELECT city, CAST(num_trips AS DOUBLE) AS v FROM route_stats", 30)
SQL["stops_histogram"] = _hist("SELECT city, CAST(num_stops AS DOUBLE) AS v FROM route_stats", 30)
SQL["routes_per_stop_histogram"] = _hist("SELECT city, CAST(num_routes AS DOUBLE) AS v FROM spatial_stats", 20)
SQL["headway_histogram"] = _hist(_HW, 50)
SQL["headway_cdf"] = _hist(_HW, 50, cdf=True)
SQL["headway_box"] = qs(
    f", hw AS ({_HW}), qq AS (SELECT city, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
    f"quantile_cont(v, 0.75) AS q3 FROM hw GROUP BY city) "
    f"SELECT city, round(q1, {D}) AS q1, round(median, {D}) AS median, round(q3, {D}) AS q3, "
    f"round(q3 - q1, {D}) AS iqr, "
    f"round(min(v) FILTER (WHERE v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1)), {D}) AS whisker_low, "
    f"round(max(v) FILTER (WHERE v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1)), {D}) AS whisker_high, "
    f"count_if(NOT (v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1))) AS outliers "
    f"FROM hw JOIN qq USING (city) GROUP BY city, q1, median, q3")


# ---------------------------------------------------------------- store / reports
_GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
SQL["table_stats"] = (f"WITH t AS ({_union_all([f'SELECT {t!r} AS table_name, count(*) AS rows FROM {t}' for t in _GIVEN])}) "
                      "SELECT * FROM t UNION ALL SELECT 'total', CAST(sum(rows) AS BIGINT) FROM t")
_TYPE_NAMES = ("CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
               "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' "
               "ELSE column_type END")
SQL["table_schema"] = _union_all([
    f"SELECT '{t}' AS table_name, CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name, {_TYPE_NAMES} AS data_type "
    f"FROM (DESCRIBE {t})" for t in _GIVEN[:8]])
_MISSING_COLS = ["arrival_time", "route_long_name", "route_short_name"]
SQL["missing_matrix"] = (
    "SELECT table_name, " + ", ".join(f"max(missing_pct) FILTER (WHERE column_name = '{c}') AS {c}" for c in _MISSING_COLS)
    + f" FROM ({SQL['missing_values']}) GROUP BY table_name")
SQL["write_read_results"] = q(f"SELECT ride_id, city, service, {_r('distance_km fare')} FROM rides")
SQL["normalize_columns"] = "SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderpriority AS priority FROM orders"
SQL["check_structure"] = q(_union_all(
    [f"SELECT '{t}' AS table_name, count(*) AS rows, true AS passed FROM {t}" for t in ("stop_times", "trips", "routes", "stops")]
    + ["SELECT 'routes without names' AS table_name, count(*) AS rows, false AS passed FROM routes"]))
SQL["table_sample"] = "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5"
SQL["read_table"] = q("SELECT * FROM stop_times WHERE city = 'delhi'")
_TOP20 = (f"(SELECT city, rank, route_id, {_NAME} AS route_name, num_trips FROM (SELECT *, "
          f"CAST(row_number() OVER (PARTITION BY city ORDER BY num_trips DESC, route_id) AS INTEGER) AS rank "
          f"FROM route_stats) WHERE rank <= 20)")
SQL["route_mapping_report"] = qs(f", top20 AS {_TOP20} " + " UNION ALL ".join([
    "SELECT city, rank, 0 AS n, 'Route ID: ' || CAST(route_id AS VARCHAR) AS line FROM top20",
    "SELECT city, rank, 1 AS n, 'Route Name: ' || route_name AS line FROM top20",
    "SELECT city, rank, 2 AS n, 'Number of Trips: ' || CAST(num_trips AS VARCHAR) AS line FROM top20",
    f"SELECT city, rank, 3 AS n, '{'-' * 30}' AS line FROM top20"]))
SQL["executive_summary"] = qs(
    "SELECT string_agg(city, ',' ORDER BY city) AS cities, CAST(sum(coalesce(total_routes, 0)) AS BIGINT) "
    "AS total_routes, count(*) AS cities_analyzed, "
    "(SELECT CAST(count(DISTINCT x) AS INTEGER) FROM (SELECT unnest(string_split(improvement_areas, '|')) AS x "
    "FROM assess) WHERE x <> '') AS recommendations_provided FROM assess")


def _nudge_rounding(sql: str) -> str:
    """round(x, DIGITS) -> round((x) + NUDGE, DIGITS), matching ``plans.common.rounded``."""
    out, i, tail = [], 0, f", {D})"
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        call = sql[j:k]
        if call.endswith(tail):
            inner = _nudge_rounding(call[6:-len(tail)])
            call = f"round(({inner}) + {NUDGE!r}, {D})"
        else:
            call = "round(" + _nudge_rounding(call[6:])
        out.append(sql[i:j])
        out.append(call)
        i = k


def _bigint_count_if(sql: str) -> str:
    """count_if(x) -> CAST(count_if(x) AS BIGINT): DuckDB returns HUGEINT, Spark bigint."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j])
        out.append(f"CAST(count_if({_bigint_count_if(sql[j + 9:k - 1])}) AS BIGINT)")
        i = k


# ---------------------------------------------------------------- model inputs and metrics
_FEATURES = [*K.MODEL_FEATURES, "city_index"]
_PREPARED = f""",
split AS (SELECT *, {_BUCKET} < 800 AS in_train, avg_surge_multiplier AS label FROM modeling),
cities AS (
  SELECT city, row_number() OVER (ORDER BY count(*) DESC, city) - 1 AS place, count(*) OVER () AS n FROM split WHERE in_train GROUP BY city),
indexed AS (
  SELECT s.*, CAST(coalesce(c.place, (SELECT max(n) FROM cities)) AS DOUBLE) AS city_index FROM split s LEFT JOIN cities c ON s.city = c.city),
scales AS (SELECT {", ".join(f"stddev_samp({c}) AS {c}" for c in _FEATURES)} FROM indexed WHERE in_train),
scaled AS (
  SELECT i.city, i.hour_of_day, i.is_weekend, i.in_train, i.label,
    {", ".join(f"CASE WHEN s.{c} > 0 THEN i.{c} / s.{c} ELSE 0.0e0 END AS scaled_{c}" for c in _FEATURES)}
  FROM indexed i, scales s)
"""
_SCALED = [f"scaled_{c}" for c in _FEATURES]
SQL["prepare_features"] = _BASE + _PREPARED + (
    f"SELECT city, hour_of_day, is_weekend, round(label, {D}) AS label, {_r(' '.join(_SCALED))}, "
    "CASE WHEN in_train THEN 'train' ELSE 'test' END AS split FROM scaled")
_X = [*_SCALED, "1.0e0", "label"]
SQL["normal_equations"] = _BASE + _PREPARED + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, round(avg({_X[i]} * {_X[j]}), {D}) AS mean_product FROM scaled WHERE in_train"
    for i in range(len(_X)) for j in range(i, len(_X)))
# Gauss-Jordan elimination on the mean products of the centred training rows; a feature that depends on others is left out.
_CENTRED = [f"({c} - (SELECT avg({c}) FROM scaled WHERE in_train))" for c in [*_SCALED, "label"]]
_SIZE = len(_SCALED)
SQL["linear_fit"] = _BASE.replace("WITH ", "WITH RECURSIVE ", 1) + _PREPARED + f""",
centred AS (SELECT in_train, label, {", ".join(f"{c} AS x{i + 1}" for i, c in enumerate(_CENTRED))} FROM scaled),
start AS (
  SELECT [{", ".join("[" + ", ".join(f"avg(x{i} * x{j})" for j in range(1, _SIZE + 2)) + "]" for i in range(1, _SIZE + 1))}] AS m
  FROM centred WHERE in_train),
steps(k, m) AS (
  SELECT 0, m FROM start
  UNION ALL
  SELECT k + 1, CASE WHEN abs(m[k + 1][k + 1]) < 1e-9 THEN m ELSE
    list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
      ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) END
  FROM steps WHERE k < {_SIZE}),
weights AS (SELECT list_transform(m, lambda r, i: CASE WHEN abs(r[i] - 1) < 1e-6 THEN r[{_SIZE + 1}] ELSE 0.0e0 END) AS w FROM steps WHERE k = {_SIZE}),
guessed AS (
  SELECT CASE WHEN in_train THEN 'train' ELSE 'test' END AS split, label,
    {" + ".join(f"w[{i}] * x{i}" for i in range(1, _SIZE + 1))} - x{_SIZE + 1} AS error
  FROM centred, weights),
measured AS (
  SELECT split, sqrt(avg(error * error)) AS "RMSE", avg(abs(error)) AS "MAE", 1 - avg(error * error) / var_pop(label) AS "R2"
  FROM guessed GROUP BY split)
SELECT split, metric, round(value, {D}) AS value FROM measured UNPIVOT (value FOR metric IN ("RMSE", "MAE", "R2"))
"""
_RULE_SCORES = f""",
rule_scores AS (
  SELECT ride_id, round(greatest({_lit(K.SURGE_MIN)}, least({_lit(K.SURGE_MAX)}, 1.0e0 + time_band_surge
    + weekend_surge + calendar_surge + area_surge + season_surge)), {D}) AS score FROM parts)
"""
_RULE = """,
rule AS (
  SELECT r.city, r.surge_multiplier AS label, s.score AS prediction FROM rides r JOIN rule_scores s USING (ride_id))
"""
SQL["rule_regression_metrics"] = _BASE + _SCORE + _RULE_SCORES + _RULE + f""",
measured AS (
  SELECT city, sqrt(avg((prediction - label) ** 2)) AS "RMSE", avg(abs(prediction - label)) AS "MAE",
    1 - avg((prediction - label) ** 2) / var_pop(label) AS "R2"
  FROM rule GROUP BY city)
SELECT city, metric, round(value, {D}) AS value FROM measured UNPIVOT (value FOR metric IN ("RMSE", "MAE", "R2"))
"""
SQL["rule_classification_metrics"] = _BASE + _SCORE + _RULE_SCORES + _RULE + f""",
marked AS (
  SELECT city, label > {_lit(K.HIGH_SURGE_THRESHOLD)} AS y, prediction > {_lit(K.HIGH_SURGE_THRESHOLD)} AS guess,
    rank() OVER (PARTITION BY city ORDER BY prediction) + (count(*) OVER (PARTITION BY city, prediction) - 1) / 2.0e0 AS place
  FROM rule),
totals AS (
  SELECT city, count(*) FILTER (y)::DOUBLE AS p, count(*) FILTER (NOT y)::DOUBLE AS n, sum(place) FILTER (y) AS places,
    count(*) FILTER (y AND guess)::DOUBLE AS tp, count(*) FILTER (NOT y AND guess)::DOUBLE AS fp,
    count(*) FILTER (y AND NOT guess)::DOUBLE AS fn, count(*) FILTER (NOT y AND NOT guess)::DOUBLE AS tn
  FROM marked GROUP BY city),
measured AS (
  SELECT city, (places - p * (p + 1) / 2) / (p * n) AS "AUC", (tp + tn) / (p + n) AS "Accuracy",
    (p * 2 * tp / (2 * tp + fp + fn) + n * 2 * tn / (2 * tn + fp + fn)) / (p + n) AS "F1"
  FROM totals)
SELECT city, metric, round(value, {D}) AS value FROM measured UNPIVOT (value FOR metric IN ("AUC", "Accuracy", "F1"))
"""

# ---------------------------------------------------------------- the text report
def _body(key: str) -> str:
    return SQL[key][len(_BASE):]


SQL["profile_report"] = _BASE + f""",
profile AS ({_body("profile_table")}),
missing AS ({_body("missing_values")}),
issues AS (SELECT * FROM ({_ISSUES}) WHERE count > 0)
SELECT '' AS table_name, -1 AS section, 0 AS n, 'EDA Report - BINDINGS' AS line
UNION ALL SELECT '', -1, 1, repeat('=', 50)
UNION ALL SELECT table_name, 0, 0, upper(table_name) || ' ANALYSIS' FROM profile
UNION ALL SELECT table_name, 0, 1, 'Records: ' || format('{{:,}}', n_rows) FROM profile
UNION ALL SELECT table_name, 0, 2, 'Columns: ' || n_columns FROM profile
UNION ALL SELECT table_name, 0, 4, 'Duplicates: ' || duplicates FROM profile
UNION ALL SELECT table_name, 1, -1, CASE WHEN table_name IN (SELECT table_name FROM missing) THEN ' MISSING VALUES:' ELSE ' No missing values' END FROM profile
UNION ALL SELECT table_name, 1, 0, '  ' || column_name || ': ' || format('{{:,}}', missing) || ' (' || format('{{:.1f}}', missing_pct) || '%)' FROM missing
UNION ALL SELECT table_name, 3, -1,
  CASE WHEN table_name IN (SELECT table_name FROM issues) THEN ' DATA QUALITY ISSUES:' ELSE ' No data quality issues' END FROM profile
UNION ALL SELECT table_name, 3, CASE issue WHEN 'negative_values' THEN 0 WHEN 'zero_values' THEN 1 ELSE 2 END,
  '  ' || issue || '_' || column_name || ': ' || format('{{:,}}', count) FROM issues
"""
SQL["off_peak_hour"] = qs("SELECT city, off_peak_hour FROM sprof")


SQL |= file_oracle.statements(q, D, CITIES)


def oracle_sql() -> dict[str, str]:
    return {k: _bigint_count_if(_nudge_rounding(v)) for k, v in SQL.items()}


__all__ = ["oracle_sql", "SQL", "CITIES"]
