"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They run the library operators over the binding views of the driver's test
tables (whole tables, no sampling) and round doubles like the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis import constants as K
from mobilis.functions.labels import route_label, route_name, stop_label
from mobilis.functions.rides import ride_time_features
from mobilis.functions.surge import estimated_duration, season_surge, time_band_surge, weekend_surge
from mobilis.operators import clean as C
from mobilis.operators import distribution as DI
from mobilis.operators import metrics as ME
from mobilis.operators import model as M
from mobilis.operators import profile as PR
from mobilis.operators import report as RP
from mobilis.operators import rides as R
from mobilis.operators import scoring as P
from mobilis.operators import summaries as S
from mobilis.operators import topk as X
from mobilis.operators import transit as T
from mobilis.plans.common import rounded, stored
from mobilis.schemas import FEED_SCHEMAS
from mobilis.session import scratch_path
from mobilis.sources import bindings as B
from mobilis.sources import feeds as FD
from mobilis.sources import tables as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def events_of(spark: SparkSession, sf: str) -> DataFrame:
    return T.build_events(B.transit_feed(spark, sf))


# ---------------------------------------------------------------- cleaning
@register("clean_routes")
def q_clean_routes(spark, sf):
    return C.clean_routes(B.view(spark, sf, "routes"))


@register("clean_trips")
def q_clean_trips(spark, sf):
    return C.clean_trips(B.view(spark, sf, "trips"))


@register("clean_stops")
def q_clean_stops(spark, sf):
    return rounded(C.clean_stops(B.view(spark, sf, "stops")))


@register("clean_stop_times")
def q_clean_stop_times(spark, sf):
    return (C.clean_stop_times(B.view(spark, sf, "stop_times"))
            .select("city", "trip_id", "stop_id", "stop_sequence", "arrival_time"))


@register("parse_service_time")
def q_parse_service_time(spark, sf):
    return (C.clean_stop_times(B.view(spark, sf, "stop_times"))
            .select("city", "trip_id", "stop_id", "stop_sequence", "arrival_time", "arrival_time_clean",
                    "arrival_hour", "arrival_minute", "arrival_second", "arrival_total_seconds"))


# ---------------------------------------------------------------- fact + metrics
@register("trip_stop_events")
def q_trip_stop_events(spark, sf):
    return rounded(events_of(spark, sf).select(
        "city", "trip_id", "stop_id", "stop_sequence", "arrival_time", "arrival_hour",
        "arrival_total_seconds", "route_id", "service_id", "route_short_name", "route_long_name",
        "stop_name", "stop_lat", "stop_lon"))


def metrics_of(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    """Metrics over one stored fact with just the columns they read.

    The joins run once, and the fact is written as Parquet under the shared
    checkpoint folder: metrics read it several times, a few columns each, and
    a lost executor re-reads it instead of redoing the joins.
    """
    events = events_of(spark, sf)
    events = stored(events.select(*T.metric_columns(events, list(names))), "fact")
    return {m: T.METRICS[m](events) for m in names}


@register("route_stats")
def q_route_stats(spark, sf):
    return rounded(metrics_of(spark, sf, "route_stats")["route_stats"])


@register("hourly_service")
def q_hourly_service(spark, sf):
    return metrics_of(spark, sf, "hourly_service")["hourly_service"]


@register("spatial_stats")
def q_spatial_stats(spark, sf):
    return rounded(metrics_of(spark, sf, "spatial_stats")["spatial_stats"])


HEADWAY_COLUMNS = ["city", "route_id", "stop_id", "trip_id", "stop_sequence", "arrival_time", "arrival_hour",
                   "arrival_total_seconds", "service_id"]


@register("headways")
def q_headways(spark, sf):
    return T.headways(stored(events_of(spark, sf).select(*HEADWAY_COLUMNS), "fact")).select(
        *HEADWAY_COLUMNS, "prev_arrival", "headway_seconds")


# ---------------------------------------------------------------- summaries
def _strings(df: DataFrame, *cols: str) -> DataFrame:
    """Arrays of texts as one '|'-joined string (flat values for the oracle)."""
    return df.withColumns({c: F.concat_ws("|", c) for c in cols})


@register("route_summary")
def q_route_summary(spark, sf):
    return rounded(S.route_summary(metrics_of(spark, sf, "route_stats")["route_stats"]))


@register("headway_summary")
def q_headway_summary(spark, sf):
    return rounded(S.headway_summary(metrics_of(spark, sf, "headway_gaps")["headway_gaps"]))


@register("service_profile")
def q_service_profile(spark, sf):
    sp = S.service_profile(metrics_of(spark, sf, "hourly_service")["hourly_service"])
    return sp.select("city", "peak_hour", "peak_hour_trips", "off_peak_hour", "total_service_hours",
                     F.size("service_gaps").alias("n_service_gaps"))


@register("hourly_profile_series")
def q_hourly_profile_series(spark, sf):
    return S.hourly_profile(metrics_of(spark, sf, "hourly_service")["hourly_service"])


@register("service_gaps")
def q_service_gaps(spark, sf):
    return S.service_gaps(stored(metrics_of(spark, sf, "hourly_service")["hourly_service"]))


@register("stop_summary")
def q_stop_summary(spark, sf):
    return rounded(S.stop_summary(metrics_of(spark, sf, "spatial_stats")["spatial_stats"]))


@register("city_assessment")
def q_city_assessment(spark, sf):
    m = metrics_of(spark, sf, "route_stats", "headway_gaps")
    a = S.city_assessment(S.route_summary(m["route_stats"]), S.headway_summary(m["headway_gaps"]))
    return _strings(a, "key_strengths", "improvement_areas")


@register("city_analysis")
def q_city_analysis(spark, sf):
    m = metrics_of(spark, sf, "route_stats", "headway_gaps", "hourly_service", "spatial_stats")
    ca = S.city_analysis(m["route_stats"], m["headway_gaps"], m["hourly_service"], m["spatial_stats"])
    ca = _strings(ca, "key_strengths", "improvement_areas")
    return rounded(ca.withColumn("n_service_gaps", F.size("service_gaps"))
                     .drop("service_gaps", "daily_trip_pattern"))


@register("transit_city_comparison")
def q_transit_city_comparison(spark, sf):
    m = metrics_of(spark, sf, "route_stats", "headway_gaps", "hourly_service", "spatial_stats")
    return rounded(S.transit_city_comparison(m["route_stats"], m["headway_gaps"], m["spatial_stats"],
                                             m["hourly_service"]))


@register("record_count_comparison")
def q_record_count_comparison(spark, sf):
    return S.record_counts(events_of(spark, sf))


@register("total_routes_rollup")
def q_total_routes_rollup(spark, sf):
    m = metrics_of(spark, sf, "route_stats", "headway_gaps")
    a = S.city_assessment(S.route_summary(m["route_stats"]), S.headway_summary(m["headway_gaps"]))
    return S.total_routes_rollup(a)


@register("route_frequency_mix")
def q_route_frequency_mix(spark, sf):
    return rounded(S.route_frequency_mix(stored(metrics_of(spark, sf, "route_stats")["route_stats"])))


# ---------------------------------------------------------------- top-k
@register("busiest_routes")
def q_busiest_routes(spark, sf):
    return X.busiest_routes(metrics_of(spark, sf, "route_stats")["route_stats"])


@register("top_routes")
def q_top_routes(spark, sf):
    return X.top_routes(metrics_of(spark, sf, "route_stats")["route_stats"])


@register("least_used_routes")
def q_least_used_routes(spark, sf):
    return X.least_used_routes(metrics_of(spark, sf, "route_stats")["route_stats"])


@register("transfer_points")
def q_transfer_points(spark, sf):
    return X.transfer_points(metrics_of(spark, sf, "spatial_stats")["spatial_stats"])


@register("busiest_route")
def q_busiest_route(spark, sf):
    return X.busiest_route(metrics_of(spark, sf, "route_stats")["route_stats"])


@register("peak_hour")
def q_peak_hour(spark, sf):
    sp = S.service_profile(metrics_of(spark, sf, "hourly_service")["hourly_service"])
    return sp.select("city", "peak_hour", "peak_hour_trips", "off_peak_hour")


@register("off_peak_hour")
def q_off_peak_hour(spark, sf):
    return S.service_profile(metrics_of(spark, sf, "hourly_service")["hourly_service"]).select("city", "off_peak_hour")


@register("demand_service_gap")
def q_demand_service_gap(spark, sf):
    m = metrics_of(spark, sf, "route_stats", "hourly_service")
    return rounded(X.demand_service_gap(m["route_stats"], m["hourly_service"]))


@register("underserved_vs_average")
def q_underserved_vs_average(spark, sf):
    m = metrics_of(spark, sf, "route_stats", "hourly_service")
    return rounded(X.underserved_vs_average(m["route_stats"], m["hourly_service"]))


@register("route_label")
def q_route_label(spark, sf):
    rs = metrics_of(spark, sf, "route_stats")["route_stats"]
    return rs.select("city", "route_id", route_label().alias("route_label"))


@register("route_name_map")
def q_route_name_map(spark, sf):
    r = C.clean_routes(B.view(spark, sf, "routes"))
    return r.select("city", "route_id", route_name().alias("route_name"))


@register("stop_label")
def q_stop_label(spark, sf):
    sp = metrics_of(spark, sf, "spatial_stats")["spatial_stats"]
    return sp.select("city", "stop_id", stop_label().alias("stop_label"))


# ---------------------------------------------------------------- rides
def rides_of(spark: SparkSession, sf: str) -> DataFrame:
    return B.rides(spark, sf)


def prepared_of(spark: SparkSession, sf: str) -> DataFrame:
    return R.preprocess_rides(rides_of(spark, sf))


@register("ride_time_features")
def q_ride_time_features(spark, sf):
    return ride_time_features(rides_of(spark, sf)).select(
        "ride_id", "city", "hour", "day_of_week", "is_weekend", "is_peak_hour")


@register("ride_ratios")
def q_ride_ratios(spark, sf):
    return rounded(R.ride_ratios(rides_of(spark, sf)).select("ride_id", "fare_per_km", "speed_kmh"))


@register("ride_outlier_filter")
def q_ride_outlier_filter(spark, sf):
    return rounded(prepared_of(spark, sf).select("ride_id", "city", "service", "distance_km", "fare",
                                                 "duration_mins", "fare_per_km", "speed_kmh"))


@register("ride_feature_columns")
def q_ride_feature_columns(spark, sf):
    return rounded(R.ride_feature_columns(rides_of(spark, sf)).select(
        "ride_id", "city", "hour_of_day", "day_of_week", "is_weekend", "is_peak_hour", "fare_per_km"))


@register("ride_default_columns")
def q_ride_default_columns(spark, sf):
    """Rides stored without duration and surge columns get the defaults (0.0 and 1.0)."""
    r = R.with_ride_defaults(rides_of(spark, sf).drop("duration_mins", "surge_multiplier"))
    return rounded(r.select("ride_id", "fare", "duration_mins", "surge_multiplier"))


@register("typed_or_string")
def q_typed_or_string(spark, sf):
    """Stop times as text (as a CSV read gives them), cast by name to the feed schema."""
    st = B.view(spark, sf, "stop_times")
    text = st.select(*[F.col(c).cast("string").alias(c) for c in st.columns])
    return FD.typed_or_string(text, FEED_SCHEMAS["stop_times"])


@register("ride_price_by_type")
def q_ride_price_by_type(spark, sf):
    return rounded(R.ride_price_by_type(prepared_of(spark, sf)))


@register("ride_distance_by_type")
def q_ride_distance_by_type(spark, sf):
    return rounded(R.ride_distance_by_type(prepared_of(spark, sf)))


@register("service_popularity")
def q_service_popularity(spark, sf):
    return rounded(R.service_popularity(prepared_of(spark, sf)))


@register("hourly_surge")
def q_hourly_surge(spark, sf):
    return rounded(R.hourly_surge(prepared_of(spark, sf)))


@register("peak_vs_offpeak")
def q_peak_vs_offpeak(spark, sf):
    return rounded(R.peak_vs_offpeak(prepared_of(spark, sf)))


@register("weekend_vs_weekday")
def q_weekend_vs_weekday(spark, sf):
    return rounded(R.weekend_vs_weekday(prepared_of(spark, sf)))


@register("ride_comparison_projection")
def q_ride_comparison_projection(spark, sf):
    return rounded(R.ride_comparison_projection(prepared_of(spark, sf)))


@register("ride_features")
def q_ride_features(spark, sf):
    return rounded(R.ride_features(rides_of(spark, sf)))


@register("fill_feature_nulls")
def q_fill_feature_nulls(spark, sf):
    f = R.ride_features(rides_of(spark, sf))
    return rounded(f.select("city", "hour_of_day", "is_weekend", *R.FEATURE_FILL))


@register("modeling_dataset")
def q_modeling_dataset(spark, sf):
    return rounded(R.modeling_dataset(rides_of(spark, sf)))


@register("demand_index")
def q_demand_index(spark, sf):
    m = R.modeling_dataset(rides_of(spark, sf))
    return rounded(m.select("city", "hour_of_day", "is_weekend", "ride_count", "is_peak_hour", "demand_index"))


@register("union_cities")
def q_union_cities(spark, sf):
    r = rides_of(spark, sf)
    per_city = [R.ride_features(r.where(F.col("city") == c)) for c in B.CITIES]
    return rounded(R.union_cities(per_city))


@register("concat_tagged")
def q_concat_tagged(spark, sf):
    r = rides_of(spark, sf)
    frames = {c: r.where(F.col("city") == c).select("service", "fare", "distance_km", "surge_multiplier")
              for c in B.CITIES}
    return rounded(R.concat_tagged(frames))


@register("simple_ride_dataset")
def q_simple_ride_dataset(spark, sf):
    return rounded(R.simple_ride_dataset(rides_of(spark, sf)))


@register("surge_label")
def q_surge_label(spark, sf):
    m = R.surge_label(R.modeling_dataset(rides_of(spark, sf)), "classification")
    return rounded(m.select("city", "hour_of_day", "is_weekend", "avg_surge_multiplier", "high_surge", "label"))


@register("city_ride_stats")
def q_city_ride_stats(spark, sf):
    return rounded(R.city_ride_stats(rides_of(spark, sf)))


@register("ride_count_check")
def q_ride_count_check(spark, sf):
    return S.record_counts(rides_of(spark, sf)).withColumnRenamed("records", "rides")


@register("cross_city_pricing")
def q_cross_city_pricing(spark, sf):
    return rounded(R.cross_city_pricing(rides_of(spark, sf), B.CITIES))


@register("fare_pivot")
def q_fare_pivot(spark, sf):
    return rounded(R.fare_pivot(rides_of(spark, sf)))


@register("service_mix_pivot")
def q_service_mix_pivot(spark, sf):
    return R.service_mix_pivot(rides_of(spark, sf))


@register("fare_distance_points")
def q_fare_distance_points(spark, sf):
    return rounded(R.fare_distance_points(rides_of(spark, sf)))


@register("model_city_summary")
def q_model_city_summary(spark, sf):
    return rounded(R.model_city_summary(R.modeling_dataset(rides_of(spark, sf))))


@register("ride_comparison")
def q_ride_comparison(spark, sf):
    return rounded(R.ride_comparison(rides_of(spark, sf), B.CITIES))


# ---------------------------------------------------------------- scoring
@register("haversine_km")
def q_haversine_km(spark, sf):
    return rounded(P.straight_distance(rides_of(spark, sf)).select("ride_id", "straight_km"))


@register("estimated_duration")
def q_estimated_duration(spark, sf):
    s = P.straight_distance(rides_of(spark, sf))
    # The traffic factor is a parameter (the original rule draws one in [1.2, 2.0]).
    return s.select("ride_id", estimated_duration("straight_km", 1.5).alias("est_duration_mins"))


@register("time_band_surge")
def q_time_band_surge(spark, sf):
    return rides_of(spark, sf).select("ride_id", time_band_surge("timestamp").alias("time_band_surge"))


@register("weekend_surge")
def q_weekend_surge(spark, sf):
    return rides_of(spark, sf).select("ride_id", weekend_surge("timestamp").alias("weekend_surge"))


@register("season_surge")
def q_season_surge(spark, sf):
    return rides_of(spark, sf).select("ride_id", season_surge("timestamp").alias("season_surge"))


@register("area_surge")
def q_area_surge(spark, sf):
    return rounded(P.area_surge(rides_of(spark, sf)).select("ride_id", "area_surge"))


@register("calendar_surge")
def q_calendar_surge(spark, sf):
    return rounded(P.calendar_surge(rides_of(spark, sf)).select("ride_id", "calendar_surge"))


@register("surge_multiplier")
def q_surge_multiplier(spark, sf):
    return rounded(P.surge_multiplier(rides_of(spark, sf)).select("ride_id", "surge_score"))


@register("tariff_fare")
def q_tariff_fare(spark, sf):
    return rounded(P.tariff_fare(rides_of(spark, sf)).select("ride_id", "service", "vehicle_type", "tariff_fare"))


@register("ride_demand_struct")
def q_ride_demand_struct(spark, sf):
    d = P.ride_demand_struct(rides_of(spark, sf))
    return d.select("ride_id", "demand_features.*")


# ---------------------------------------------------------------- profile
@register("profile_table")
def q_profile_table(spark, sf):
    return PR.profile_tables(B.profile_views(spark, sf))


@register("table_size_comparison")
def q_table_size_comparison(spark, sf):
    return PR.table_size_comparison(B.profile_views(spark, sf))


@register("numeric_stats")
def q_numeric_stats(spark, sf):
    return rounded(PR.numeric_stats(B.profile_views(spark, sf)))


@register("missing_values")
def q_missing_values(spark, sf):
    return rounded(PR.missing_values(B.profile_views(spark, sf)))


@register("quality_negative")
def q_quality_negative(spark, sf):
    return PR.sign_issues(B.profile_views(spark, sf)).where(F.col("issue") == "negative_values")


@register("quality_zero")
def q_quality_zero(spark, sf):
    return PR.sign_issues(B.profile_views(spark, sf)).where(F.col("issue") == "zero_values")


@register("quality_outliers")
def q_quality_outliers(spark, sf):
    return PR.outlier_issues(B.profile_views(spark, sf))


@register("quality_issue_matrix")
def q_quality_issue_matrix(spark, sf):
    return PR.quality_issue_matrix(B.profile_views(spark, sf))


@register("profile_report")
def q_profile_report(spark, sf):
    views = B.profile_views(spark, sf)
    return RP.profile_report("bindings", stored(PR.profile_tables(views)), stored(PR.missing_values(views)),
                             stored(PR.quality_issues(views)))


@register("missing_matrix")
def q_missing_matrix(spark, sf):
    return rounded(PR.missing_matrix(B.profile_views(spark, sf)))


@register("table_schema")
def q_table_schema(spark, sf):
    return PR.table_schema({t: B.read_table(spark, sf, t) for t in STAR_TABLES})


@register("top_categories")
def q_top_categories(spark, sf):
    return PR.top_categories(B.profile_views(spark, sf))


# ---------------------------------------------------------------- distributions
@register("trips_histogram")
def q_trips_histogram(spark, sf):
    return rounded(DI.trips_histogram(stored(metrics_of(spark, sf, "route_stats")["route_stats"])))


@register("stops_histogram")
def q_stops_histogram(spark, sf):
    return rounded(DI.stops_histogram(stored(metrics_of(spark, sf, "route_stats")["route_stats"])))


@register("routes_per_stop_histogram")
def q_routes_per_stop_histogram(spark, sf):
    return rounded(DI.routes_per_stop_histogram(stored(metrics_of(spark, sf, "spatial_stats")["spatial_stats"])))


def _headway_values(spark: SparkSession, sf: str) -> DataFrame:
    """The two columns that the headway distributions read, written once for their several passes."""
    return stored(metrics_of(spark, sf, "headway_gaps")["headway_gaps"].select("city", "headway_seconds"))


@register("headway_histogram")
def q_headway_histogram(spark, sf):
    return rounded(DI.headway_histogram(_headway_values(spark, sf)))


@register("headway_cdf")
def q_headway_cdf(spark, sf):
    return rounded(DI.headway_cdf(_headway_values(spark, sf)))


@register("headway_box")
def q_headway_box(spark, sf):
    return rounded(DI.headway_box(_headway_values(spark, sf)))


# ---------------------------------------------------------------- models (rows-only checks)
_MODELS: dict[tuple, str] = {}  # where the models of an application's modelling rows are saved


def fitted(spark: SparkSession, sf: str, problem_type: str):
    """(train, test, models, feature names); models are trained once per application and content of the modelling rows.

    Rows and models are files: train and test are written, models saved and
    loaded, so a query depends on nothing that another one keeps in memory.
    """
    modeling = stored(R.modeling_dataset(rides_of(spark, sf)), "modeling")
    rows = rounded(modeling, 9)
    content = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("x")).first()
    train, test, _, cols = M.prepare_features(modeling, problem_type)
    train, test = stored(train, "train"), stored(test, "test")
    key = (spark.sparkContext.applicationId, problem_type, content.n, content.x)
    if key not in _MODELS:
        root = scratch_path(spark, f"models-{problem_type}")
        M.save_models(M.train_models(train, problem_type), problem_type, root)
        _MODELS[key] = root
    return train, test, M.load_models(spark, problem_type, _MODELS[key]), cols


@register("split_data")
def q_split_data(spark, sf):
    train, test = M.split_data(R.modeling_dataset(rides_of(spark, sf)))
    return (train.select(*M.KEY_COLUMNS, F.lit("train").alias("split"))
            .unionByName(test.select(*M.KEY_COLUMNS, F.lit("test").alias("split"))))


@register("prepare_features")
def q_prepare_features(spark, sf):
    train, test, _, cols = M.prepare_features(R.modeling_dataset(rides_of(spark, sf)), "regression")
    return rounded(M.feature_rows(train, cols).withColumn("split", F.lit("train"))
                   .unionByName(M.feature_rows(test, cols).withColumn("split", F.lit("test"))))


@register("normal_equations")
def q_normal_equations(spark, sf):
    """What the linear fit reads of the training rows: mean products of scaled features, 1 and label."""
    train, _, _, cols = M.prepare_features(R.modeling_dataset(rides_of(spark, sf)), "regression")
    return rounded(M.normal_equations(M.feature_rows(train, cols), [f"scaled_{c}" for c in cols]))


@register("linear_fit")
def q_linear_fit(spark, sf):
    """Errors of the linear fit, solved from the normal equations, on training and test rows."""
    train, test, _, cols = M.prepare_features(R.modeling_dataset(rides_of(spark, sf)), "regression")
    scaled = [f"scaled_{c}" for c in cols]
    *weights, intercept = M.solve_linear(M.normal_equations(M.feature_rows(train, cols), scaled), len(cols))
    guess = F.lit(intercept)
    for c, w in zip(scaled, weights, strict=True):
        guess = guess + F.col(c) * F.lit(w)
    both = (M.feature_rows(train, cols).withColumn("split", F.lit("train"))
            .unionByName(M.feature_rows(test, cols).withColumn("split", F.lit("test"))))
    return rounded(ME.regression_metrics(both.select("split", "label", guess.alias("prediction")), ["split"]))


def _rule_scores(spark, sf):
    return rounded(P.surge_multiplier(rides_of(spark, sf)).select("city", "surge_multiplier", "surge_score"))


@register("rule_regression_metrics")
def q_rule_regression_metrics(spark, sf):
    """How well the surge rules predict the recorded surge of every ride."""
    rows = _rule_scores(spark, sf).select("city", F.col("surge_multiplier").alias("label"), F.col("surge_score").alias("prediction"))
    return rounded(ME.regression_metrics(rows, ["city"]))


@register("rule_classification_metrics")
def q_rule_classification_metrics(spark, sf):
    """The same for surges above the threshold."""
    rows = ME.binary_predictions(_rule_scores(spark, sf), F.col("surge_multiplier") > K.HIGH_SURGE_THRESHOLD, F.col("surge_score"),
                                 K.HIGH_SURGE_THRESHOLD, ["city"])
    return rounded(ME.classification_metrics(rows, ["city"]))


@register("model_predictions")
def q_model_predictions(spark, sf):
    """Every model's prediction of every test row."""
    out = []
    for p in PROBLEMS:
        _, test, models, _ = fitted(spark, sf, p)
        out.append(M.predictions(models, test, p)[0].withColumn("problem_type", F.lit(p)))
    return rounded(out[0].unionByName(out[1]))


def _facts(spark, sf, problem_type):
    train, _, models, _ = fitted(spark, sf, problem_type)
    return rounded(M.model_facts(models, problem_type, train))


@register("train_regression")
def q_train_regression(spark, sf):
    return _facts(spark, sf, "regression")


@register("train_classification")
def q_train_classification(spark, sf):
    return _facts(spark, sf, "classification")


def _evaluated(spark, sf, problem_type):
    _, test, models, _ = fitted(spark, sf, problem_type)
    return M.evaluate_models(models, test, problem_type)


@register("evaluate_regression")
def q_evaluate_regression(spark, sf):
    return _evaluated(spark, sf, "regression")


@register("evaluate_classification")
def q_evaluate_classification(spark, sf):
    return _evaluated(spark, sf, "classification")


PROBLEMS = ["regression", "classification"]


@register("model_comparison")
def q_model_comparison(spark, sf):
    both = [M.model_comparison(_evaluated(spark, sf, p), p).drop("timestamp") for p in PROBLEMS]
    return both[0].unionByName(both[1])


def _importance(spark, sf, problem_type):
    _, _, models, cols = fitted(spark, sf, problem_type)
    return M.feature_importance(models, cols)


@register("feature_importance")
def q_feature_importance(spark, sf):
    both = [_importance(spark, sf, p).withColumn("problem_type", F.lit(p)) for p in PROBLEMS]
    return both[0].unionByName(both[1])


def _insights(spark, sf, part):
    modeling = R.modeling_dataset(rides_of(spark, sf))
    both = [M.model_insights(modeling, _importance(spark, sf, p), p)[part] for p in PROBLEMS]
    return both[0].unionByName(both[1])


@register("model_insights")
def q_model_insights(spark, sf):
    return _insights(spark, sf, "top_features")


@register("model_recommendations")
def q_model_recommendations(spark, sf):
    return _insights(spark, sf, "recommendations")


# ---------------------------------------------------------------- store / sink
STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
GIVEN_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
                "pages", "benchmark", "labels", "conversations"]


@register("table_stats")
def q_table_stats(spark, sf):
    return ST.table_stats({t: B.read_table(spark, sf, t) for t in GIVEN_TABLES})


@register("table_sample")
def q_table_sample(spark, sf):
    return ST.table_sample(B.read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5)


@register("read_table")
def q_read_table(spark, sf):
    """The stop-time view written to a store, read back for one city (a pruned partition)."""
    store = scratch_path(spark, "store")
    ST.write_table(B.view(spark, sf, "stop_times"), f"{store}/stop_times")
    return ST.read_table(spark, store, "stop_times", "delhi")


@register("write_read_results")
def q_write_read_results(spark, sf):
    """Rides written by the result sink and read back."""
    out = scratch_path(spark, "results")
    ST.write_results({"rides": rides_of(spark, sf)}, out)
    return rounded(spark.read.parquet(f"{out}/rides").select("ride_id", "city", "service", "distance_km", "fare"))


@register("normalize_columns")
def q_normalize_columns(spark, sf):
    """Orders under column names as a feed may spell them, normalised again."""
    raw = B.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("Order Key"), F.col("o_custkey").alias("Cust-Key"),
                                                   F.col("o_orderpriority").alias("PRIORITY"))
    return FD.normalize_columns(raw)


@register("check_structure")
def q_check_structure(spark, sf):
    """Rows and verdict per feed view, and for routes without their name column."""
    feed = B.transit_feed(spark, sf)
    cases = {**feed, "routes without names": feed["routes"].select("city", "route_id")}
    verdicts = [(n, FD.check_structure(df, n.split(" ")[0])) for n, df in cases.items()]
    counts = ST.table_stats(cases).where("table_name <> 'total'")
    return counts.join(F.broadcast(spark.createDataFrame(verdicts, "table_name string, passed boolean")), "table_name")


# ---------------------------------------------------------------- reports
@register("route_mapping_report")
def q_route_mapping_report(spark, sf):
    return RP.route_mapping_report(metrics_of(spark, sf, "route_stats")["route_stats"])


@register("executive_summary")
def q_executive_summary(spark, sf):
    m = metrics_of(spark, sf, "route_stats", "headway_gaps")
    a = S.city_assessment(S.route_summary(m["route_stats"]), S.headway_summary(m["headway_gaps"]))
    e = RP.executive_summary(a)
    return e.select(F.concat_ws(",", "cities").alias("cities"), "total_routes", "cities_analyzed",
                    "recommendations_provided")


from mobilis.plans import file_queries  # noqa: E402,F401 - registers its queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)
