"""End-to-end jobs and the streaming adapter on the smallest data set."""

import os

from mobilis.operators.rides import modeling_dataset, preprocess_rides
from mobilis.plans import jobs
from mobilis.sources import bindings as B
from mobilis.streaming import rides_stream as RS

SF = "/root/testdata/sf0.001"


def test_transit_and_ride_jobs(spark, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    res = jobs.transit_job(B.transit_feed(spark, SF), out)
    assert res["route_stats"].count() > 0 and res["city_analysis"].count() == 2
    assert os.path.isdir(os.path.join(out, "route_mapping_report"))
    rides = B.rides(spark, SF)
    r = jobs.ride_job(rides, out, B.CITIES)
    assert r["modeling_dataset"].count() > 0
    assert spark.read.parquet(os.path.join(out, "scored_rides")).count() == rides.count()


def test_profile_job_writes_report(spark, tmp_dir):
    res = jobs.profile_job(B.profile_views(spark, SF), "testcity", tmp_dir)
    assert res["profile"].count() == len(B.PROFILE_VIEWS)
    text = spark.read.text(os.path.join(tmp_dir, "testcity_profile_report")).collect()
    assert text[0].value == "EDA Report - TESTCITY"


def test_ride_stream_matches_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "rides_in")
    rides = B.rides(spark, SF)
    rides.write.parquet(src)
    q = RS.start_scoring(RS.read_ride_stream(spark, src, schema=rides.schema), os.path.join(tmp_dir, "scored"),
                         os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(tmp_dir, "scored"))
    assert got.count() == preprocess_rides(rides).count()
    assert {"surge_score", "tariff_fare", "straight_km"} <= set(got.columns)


def test_sink_order(spark):
    from mobilis.operators import transit as T
    rs = T.route_stats(T.build_events(B.transit_feed(spark, SF)))
    rows = jobs.ordered("route_stats", rs).collect()
    for city in B.CITIES:
        trips = [r.num_trips for r in rows if r.city == city]
        assert trips == sorted(trips, reverse=True)


def test_model_job_saves_models(spark, tmp_dir):
    from pyspark.ml.regression import RandomForestRegressionModel
    out = jobs.model_job(modeling_dataset(B.rides(spark, "/root/testdata/sf0.01")), tmp_dir,
                         os.path.join(tmp_dir, "models"))
    assert out["model_comparison_regression"].count() == 9
    m = RandomForestRegressionModel.load(os.path.join(tmp_dir, "models", "regression_randomforestregressor"))
    assert m.getNumTrees == 50
    assert spark.read.json(os.path.join(tmp_dir, "model_insights_regression_top_features")).where("leading").count() == 5


def test_results_are_written_in_full(spark, tmp_dir):
    from mobilis.sources import tables as ST
    df = B.rides(spark, SF)
    ST.write_results({"all": df}, tmp_dir)
    assert spark.read.parquet(os.path.join(tmp_dir, "all")).count() == df.count()


def test_run_all_end_to_end(spark, tmp_dir):
    from test_feeds import _mini_feed
    base, store = os.path.join(tmp_dir, "feeds"), os.path.join(tmp_dir, "store")
    city = _mini_feed(base)
    out = jobs.run_all(spark, base, [city], store, B.rides(spark, SF), os.path.join(tmp_dir, "out"),
                       os.path.join(tmp_dir, "models"))
    summary = out["executive_summary"].first()
    assert summary.cities == [city] and summary.total_routes == 2
    assert os.path.isdir(os.path.join(tmp_dir, "out", f"{city}_profile_report"))
    assert "model_comparison_regression" in out


def test_feature_stream_matches_batch(spark, tmp_dir):
    from mobilis.operators.rides import ride_features
    src = os.path.join(tmp_dir, "rides_in")
    rides = B.rides(spark, SF)
    rides.write.parquet(src)
    q = RS.start_features(RS.read_ride_stream(spark, src, schema=rides.schema, max_files_per_trigger=2),
                          os.path.join(tmp_dir, "features"), os.path.join(tmp_dir, "ckpt_f"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(tmp_dir, "features"))
    key = ["city", "hour_of_day", "is_weekend"]
    a = {tuple(r[k] for k in key): r.ride_count for r in got.collect()}
    b = {tuple(r[k] for k in key): r.ride_count for r in ride_features(rides).collect()}
    assert a == b


def test_metrics_follow_their_formulas(spark):
    from mobilis.operators import model as M
    train, test, _, cols = M.prepare_features(modeling_dataset(B.rides(spark, SF)), "regression")
    models = {"LinearRegression": M.estimators("regression")["LinearRegression"].fit(train), "Broken": M.FailedModel("one class")}
    rows = {(r.model, r.metric): r for r in M.evaluate_models(models, test).collect()}
    p = models["LinearRegression"].transform(test).select("label", "prediction").toPandas()
    e = p.label - p.prediction
    assert abs(rows["LinearRegression", "RMSE"].value - (e ** 2).mean() ** 0.5) < 1e-9
    assert abs(rows["LinearRegression", "MAE"].value - e.abs().mean()) < 1e-9
    assert abs(rows["LinearRegression", "R2"].value - (1 - (e ** 2).sum() / ((p.label - p.label.mean()) ** 2).sum())) < 1e-9
    assert rows["Broken", "R2"].value is None and rows["Broken", "R2"].error == "one class"
    assert M.model_facts(models, "regression", train).where("model = 'LinearRegression'").first().n_coefficients == len(cols)
