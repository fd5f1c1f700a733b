"""End-to-end jobs: the pipeline steps as Spark jobs with a written result per step.

Each step reads tables and writes tables. The stop-event fact is written once
under the session's shared checkpoint folder (``spark.checkpoint.dir``) and
read back, which cuts lineage: a lost executor recomputes from the written
fact, not from the raw feed, and the four metrics share one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mobilis.operators import distribution as DI
from mobilis.operators.common import city_keys
from mobilis.operators import model as M
from mobilis.operators import profile as PR
from mobilis.operators import report as RP
from mobilis.operators import rides as R
from mobilis.operators import scoring as P
from mobilis.operators import summaries as S
from mobilis.operators import topk as X
from mobilis.operators import transit as T
from mobilis.session import scratch_path
from mobilis.sources import tables as ST


# Order of each result table at the sink (ordering happens only when writing).
SINK_ORDER = {
    "route_stats": [("num_trips", False), ("route_id", True)],
    "hourly_service": [("route_id", True), ("arrival_hour", True)],
    "ride_price_by_type": [("service", True), ("vehicle_type", True)],
    "service_popularity": [("total_rides", False), ("service", True)],
    "hourly_surge": [("hour", True), ("service", True)],
}


def ordered(name: str, df: DataFrame) -> DataFrame:
    """The result as written: sorted by its reporting order when it has one (per city)."""
    spec = SINK_ORDER.get(name)
    if not spec:
        return df
    cols = city_keys(df) + [c for c, _ in spec]
    asc = [True] * len(city_keys(df)) + [a for _, a in spec]
    return df.orderBy(*cols, ascending=asc)


def write_ordered(results: dict[str, DataFrame], out_dir: str) -> None:
    ST.write_results({k: ordered(k, v) for k, v in results.items()}, out_dir)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def transit_job(feed: dict[str, DataFrame], out_dir: str, malformed: str = "midnight") -> dict[str, DataFrame]:
    """Clean, join the fact once, compute and write the metric and summary tables."""
    events = materialize(T.build_events(feed, malformed), "trip_stop_events")
    metrics = T.transit_metrics(events)
    write_ordered(metrics, out_dir)
    m = {k: v.sparkSession.read.parquet(f"{out_dir.rstrip('/')}/{k}") for k, v in metrics.items()}
    analysis = {
        "city_analysis": S.city_analysis(m["route_stats"], m["headways"], m["hourly_service"], m["spatial_stats"]),
        "transit_city_comparison": S.transit_city_comparison(m["route_stats"], m["headways"], m["spatial_stats"],
                                                             m["hourly_service"]),
        "service_gaps": S.service_gaps(m["hourly_service"]),
        "busiest_routes": X.busiest_routes(m["route_stats"]),
        "top_routes": X.top_routes(m["route_stats"]),
        "least_used_routes": X.least_used_routes(m["route_stats"]),
        "transfer_points": X.transfer_points(m["spatial_stats"]),
        "demand_service_gap": X.demand_service_gap(m["route_stats"], m["hourly_service"]),
        "underserved_vs_average": X.underserved_vs_average(m["route_stats"], m["hourly_service"]),
        "trips_histogram": DI.trips_histogram(m["route_stats"]),
        "stops_histogram": DI.stops_histogram(m["route_stats"]),
        "headway_histogram": DI.headway_histogram(m["headways"]),
        "headway_cdf": DI.headway_cdf(m["headways"]),
        "headway_box": DI.headway_box(m["headways"]),
        "routes_per_stop_histogram": DI.routes_per_stop_histogram(m["spatial_stats"]),
        "hourly_profile": S.hourly_profile(m["hourly_service"]),
        "route_frequency_mix": S.route_frequency_mix(m["route_stats"]),
    }
    ST.write_results(analysis, out_dir)
    RP.write_lines(RP.route_mapping_report(m["route_stats"]), f"{out_dir.rstrip('/')}/route_mapping_report",
                   city_keys(m["route_stats"]) + ["rank", "n"])
    return {**m, **analysis}


def ride_job(rides: DataFrame, out_dir: str, cities: list[str]) -> dict[str, DataFrame]:
    """Ride patterns, surge patterns, features and the city comparison."""
    prepared = materialize(R.preprocess_rides(rides), "prepared_rides")
    results = {
        "ride_price_by_type": R.ride_price_by_type(prepared),
        "ride_distance_by_type": R.ride_distance_by_type(prepared),
        "service_popularity": R.service_popularity(prepared),
        "hourly_surge": R.hourly_surge(prepared),
        "peak_vs_offpeak": R.peak_vs_offpeak(prepared),
        "weekend_vs_weekday": R.weekend_vs_weekday(prepared),
        "modeling_dataset": R.modeling_dataset(rides),
        "city_ride_stats": R.city_ride_stats(rides),
        "cross_city_pricing": R.cross_city_pricing(rides, cities),
        "fare_pivot": R.fare_pivot(rides),
        "service_mix_pivot": R.service_mix_pivot(rides),
        "scored_rides": P.score_rides(rides),
    }
    write_ordered(results, out_dir)
    return results


def model_job(modeling: DataFrame, out_dir: str, model_dir: str) -> dict[str, DataFrame]:
    """Both problem types: split, fit features on train, train, evaluate, save, explain."""
    out = {}
    for problem_type in ("regression", "classification"):
        train, test, _, cols = M.prepare_features(modeling, problem_type)
        models = M.train_models(train, problem_type)
        M.save_models(models, problem_type, model_dir)
        comparison = M.model_comparison(M.evaluate_models(models, test, problem_type), problem_type)
        RP.write_json(comparison, f"{out_dir.rstrip('/')}/model_comparison_{problem_type}")
        imp = M.feature_importance(models, cols)
        insights = M.model_insights(modeling, imp, problem_type)
        for name, df in insights.items():
            RP.write_json(df, f"{out_dir.rstrip('/')}/model_insights_{problem_type}_{name}")
        out[f"model_comparison_{problem_type}"] = comparison
        if imp is not None:
            out[f"feature_importance_{problem_type}"] = imp
    return out


def profile_job(tables: dict[str, DataFrame], city: str, out_dir: str) -> dict[str, DataFrame]:
    """Profile a feed and write its tables and text report."""
    res = {k: v for k, v in PR.profile_city(tables).items() if v is not None}
    base = f"{out_dir.rstrip('/')}/profile_{city}"
    ST.write_results(res, base)
    back = {k: v.sparkSession.read.parquet(f"{base}/{k}") for k, v in res.items()}
    lines = RP.profile_report(city, back["profile"], back["missing_values"], back.get("quality_issues"))
    RP.write_lines(lines, f"{out_dir.rstrip('/')}/{city}_profile_report", ["table_name", "section", "n"])
    return back


def run_all(spark: SparkSession, feed_base: str, cities: list[str], store: str, rides: DataFrame | None,
            out_dir: str, model_dir: str) -> dict:
    """Profile and import each city's feed, then transit metrics, rides, models and the summary."""
    from mobilis.sources import feeds
    summary = {}
    for city in cities:
        names = feeds.city_files(spark, feed_base, city)
        raw = {n: PR.profile_typed(feeds.read_feed(spark, f"{feed_base}/{city}/{n}.txt", n, typed=False))
               for n in names}
        profile_job(raw, city, out_dir)
        ST.import_city(spark, feed_base, city, store)
    ready = [c for c in cities if ST.essential_gate(spark, store, c)]
    if ready:
        feed = {t: ST.read_table(spark, store, t) for t in ("stop_times", "trips", "routes", "stops")}
        feed = {t: df.where(df.city.isin(ready)) for t, df in feed.items()}
        transit = transit_job(feed, out_dir)
        summary["executive_summary"] = RP.executive_summary(S.city_assessment(
            S.route_summary(transit["route_stats"]), S.headway_summary(transit["headways"])))
        RP.write_json(summary["executive_summary"], f"{out_dir.rstrip('/')}/executive_summary")
    if rides is not None:
        r = ride_job(rides, out_dir, cities)
        summary.update(model_job(r["modeling_dataset"], out_dir, model_dir))
    return summary
