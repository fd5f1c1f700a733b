"""Bitmap distinct counts, grid areas, model metrics, stored feeds and ordered files, against brute force."""

import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from __spark_entry__ import queries
from mobilis.operators import bitmaps as BM
from mobilis.operators import metrics as ME
from mobilis.operators import model as M
from mobilis.operators import profile as PR
from mobilis.operators import quantiles as QU
from mobilis.operators import rides as R
from mobilis.operators import scoring as P
from mobilis.operators import transit as T
from mobilis.plans import jobs as J
from mobilis.plans.common import stored
from mobilis.sources import bindings as B
from mobilis.sources import feeds as FD
from mobilis.sources import tables as ST

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- bitmaps
def test_bitmap_counts_equal_distinct_counts(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([0, 1, 63, 64, 127, (3 << 33) + rng.randint(0, 200), rng.randint(0, 5000), None])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, stop_no long").withColumn("stop_id", F.col("stop_no"))
    want = {r.k: r.n for r in df.groupBy("k").agg(F.countDistinct("stop_no").alias("n")).collect()}
    assert {r.k: r.n for r in BM.distinct_count(df, ["k"], "stop_id", "n").collect()} == want
    halves = [BM.bit_words(x, ["k"], "stop_no") for x in (df.where("hash(stop_no) % 2 = 0"), df.where("hash(stop_no) % 2 <> 0"), df.limit(100))]
    assert {r.k: r.n for r in BM.count_words(BM.merge_words(halves, ["k"]), ["k"], "n").collect()} == want


def test_numbers_are_unique_and_repeatable(spark):
    dim = spark.createDataFrame([(i,) for i in range(1000)], "id long").repartition(7, "id")
    first, again = ({r.id: r.no for r in BM.numbered(dim, ["id"], "no").collect()} for _ in range(2))
    assert first == again and len(set(first.values())) == 1000


def test_metrics_neither_expand_rows_nor_sort_the_fact(spark):
    events = stored(T.build_events(B.transit_feed(spark, SF)))
    for metric in ("route_stats", "hourly_service", "spatial_stats"):
        assert "Expand" not in _plan(T.METRICS[metric](events)), metric
    for metric in ("headways", "headway_gaps"):
        assert "SortAggregate" not in _plan(T.METRICS[metric](events)), metric
    by_ids = events.drop("trip_no", "stop_no", "route_no")  # events from elsewhere carry no numbers
    for metric in ("route_stats", "hourly_service", "spatial_stats"):
        rows = [sorted(tuple(x if not isinstance(x, float) else round(x, 9) for x in r) for r in T.METRICS[metric](e).collect()) for e in (events, by_ids)]
        assert rows[0] == rows[1] and rows[0]


# ---------------------------------------------------------------- quantiles
@pytest.mark.parametrize("size,margin", [(32768, 2.0), (8, 2.0), (8, 0.001), (256, 0.5)])
def test_stats_and_outliers_like_pandas(spark, monkeypatch, size, margin):
    monkeypatch.setattr(QU, "SKETCH", size)
    monkeypatch.setattr(QU, "MARGIN", margin)
    monkeypatch.setattr(QU, "MARGIN_ROWS", 0)
    rng = np.random.default_rng(size)
    a = pd.DataFrame({"d": np.concatenate([rng.normal(0, 1, 3000), rng.normal(0, 50, 60), [np.nan] * 9]),
                      "hot": np.concatenate([np.full(2500, 7.0), rng.integers(0, 40, 569).astype(float)]),
                      "i": np.concatenate([rng.integers(-5, 5, 3060), [2 ** 53, -2 ** 53, 2 ** 53 + 1], np.arange(6) * 1000])})
    b = pd.DataFrame({"x": rng.exponential(1.0, 500)})
    frames = {"a": spark.createDataFrame(a).withColumn("none", F.lit(None).cast("double")).withColumn("text", F.lit("t")).repartition(5),
              "b": spark.createDataFrame(b), "no numbers": spark.createDataFrame([("q",)], "t string")}
    stats = {(r.table_name, r.column_name): r for r in PR.numeric_stats(frames).collect()}
    assert set(stats) == {("a", "d"), ("a", "hot"), ("a", "i"), ("b", "x")}
    issues = {(r.table_name, r.column_name): r["count"] for r in PR.outlier_issues(frames).collect()}
    for (t, c), r in stats.items():
        s = {"a": a, "b": b}[t][c].dropna()
        q = s.quantile([0.25, 0.5, 0.75])
        assert r.n == len(s) and np.allclose([r.q25, r.q50, r.q75], q, rtol=1e-12), (t, c)
        assert np.allclose([r["mean"], r["std"], r.min_value, r.max_value], [s.mean(), s.std(), s.min(), s.max()])
        lo, hi = q[0.25] - 1.5 * (q[0.75] - q[0.25]), q[0.75] + 1.5 * (q[0.75] - q[0.25])
        assert issues.get((t, c), 0) == int(((s < lo) | (s > hi)).sum()), (t, c)


def test_stats_of_columns_without_values(spark):
    df = spark.createDataFrame([(None, float("nan"))], "i int, d double")
    assert PR.numeric_stats({"t": df}).collect() == [] and PR.outlier_issues({"t": df}).collect() == []
    assert PR.numeric_stats({"t": spark.createDataFrame([("x",)], "s string")}) is None


# ---------------------------------------------------------------- heavy hitters
@pytest.mark.parametrize("tracked", [64, 2000, 10_000])
def test_top_values_of_a_hundred_thousand_distinct_ones(spark, tracked):
    rng = np.random.default_rng(tracked)
    skewed = [f"v{int(x)}" for x in np.minimum(rng.zipf(1.3, 150_000), 10 ** 9)]
    even = [f"e{i}" for i in range(100_000)] + [f"e{i}" for i in range(50_000)]
    few = [["a", "b", None][i % 3] for i in range(150_000)]
    hot = [f"h{i % 20}" if i % 4 else f"x{i}" for i in range(150_000)]  # 20 hot values of equal count, a tie at rank 10
    small = pd.DataFrame({"s": [f"s{i % 40}" if i % 7 else None for i in range(60)]})
    big = pd.DataFrame({"skewed": skewed, "even": even, "few": few, "hot": hot, "number": range(150_000)})
    frames = {"big": spark.createDataFrame(big).repartition(6), "small": spark.createDataFrame(small)}
    got = {}
    for r in PR.top_categories(frames, 10, tracked).collect():
        got.setdefault((r.table_name, r.column_name), []).append((r["rank"], r.value, r["count"]))
    assert set(got) == {("big", c) for c in ("skewed", "even", "few", "hot")} | {("small", "s")}
    for (t, c), rows in got.items():
        counts = {"big": big, "small": small}[t][c].dropna().value_counts()
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:10]
        assert sorted(rows) == [(i + 1, v, n) for i, (v, n) in enumerate(want)], (t, c)
    columns, items = PR.heavy_hitters(frames, 10, tracked)
    known = {(r.table_name, r.column_name): r.known for r in columns.collect()}
    assert known["big", "even"] == "none" and known["small", "s"] == ("all" if tracked >= 60 else "none")
    if tracked >= 2000:  # counted again and shuffled: a few values of 10 ** 5
        assert known["big", "skewed"] == known["big", "hot"] == "top"
        assert items.where("column_name in ('skewed', 'hot')").count() < 60


# ---------------------------------------------------------------- areas
def _km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


@pytest.mark.parametrize("columns", [7200, 360])
def test_ten_thousand_areas_by_brute_force(spark, columns):
    rng = random.Random(columns)
    def place():
        if rng.random() < 0.1:
            return rng.choice([89.99, -89.98, 0.0]), rng.choice([179.99, -179.99, 0.0]) + rng.uniform(-0.01, 0.01)
        return rng.uniform(12, 13), rng.uniform(77, 78)
    areas = [("c", *place(), rng.choice([0.0, 0.5, 2.0, 3.0, 8.0]), rng.uniform(0.1, 0.5)) for _ in range(10_000)]
    areas += [("other", 12.5, 77.5, 500.0, 9.0), ("c", 12.5, 77.5, None, 9.0)]
    points = [(i, "c", *place()) for i in range(150)] + [(900, None, 12.5, 77.5), (901, "nowhere", 12.5, 77.5), (902, "c", None, 77.5)]
    df = spark.createDataFrame(points, "id long, city string, start_lat double, start_lon double")
    table = spark.createDataFrame(areas, "city string, lat double, lon double, radius_km double, multiplier double")
    got = {r.id: r.area_surge for r in P.area_surge(df, areas=table, columns=columns).collect()}
    assert len(got) == len(points)
    for i, city, lat, lon in points:
        want = 0.0
        if lat is not None:
            for c, a, o, r, m in areas:
                if c == city and r and abs(lat - a) < 5 and (d := _km(lat, lon, a, o)) <= r:
                    want += m * (1 - d / r)
        assert abs(got[i] - want) < 1e-9, (i, lat, lon)


def test_areas_join_by_cell(spark):
    plan = _plan(P.area_surge(B.rides(spark, SF)))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Join" in plan


# ---------------------------------------------------------------- metrics and models
def test_metrics_equal_spark_evaluators(spark):
    rng = random.Random(4)
    rows = [(m, float(rng.random() < 0.4), float(rng.randint(-6, 6)) / (1 + k % 2)) for k in range(600) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "model string, label double, score double").withColumn("prediction", F.when(F.col("score") > 0, 1.0).otherwise(0.0))
    df = df.repartition(6)
    got = {(r.model, r.metric): r.value for r in ME.classification_metrics(df, ["model"]).collect()}
    fit = {(r.model, r.metric): r.value for r in ME.regression_metrics(df.withColumn("prediction", F.col("score")), ["model"]).collect()}
    for m in ("a", "b"):
        one = df.where(F.col("model") == m)
        for metric, e in {"Accuracy": "accuracy", "F1": "f1"}.items():
            assert abs(got[m, metric] - MulticlassClassificationEvaluator(metricName=e).evaluate(one)) < 1e-12
        assert abs(got[m, "AUC"] - BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(one)) < 1e-12
        for metric, e in {"RMSE": "rmse", "MAE": "mae", "R2": "r2"}.items():
            assert abs(fit[m, metric] - RegressionEvaluator(predictionCol="score", metricName=e).evaluate(one)) < 1e-9


def test_metrics_of_one_class_and_nulls(spark):
    df = spark.createDataFrame([("m", 1.0, 0.5, 1.0), ("m", 1.0, 0.7, 1.0), ("m", None, 0.1, 0.0), ("m", 1.0, None, None)],
                               "model string, label double, score double, prediction double")
    got = {r.metric: r.value for r in ME.classification_metrics(df, ["model"]).collect()}
    assert got == {"AUC": None, "Accuracy": 1.0, "F1": 1.0}
    fit = {r.metric: r.value for r in ME.regression_metrics(df, ["model"]).collect()}
    assert fit["RMSE"] == 0.0 and fit["R2"] is None


def test_models_saved_and_loaded_predict_alike(spark, tmp_dir):
    modeling = stored(R.modeling_dataset(B.rides(spark, SF)))
    for problem in ("regression", "classification"):
        train, test, _, cols = M.prepare_features(modeling, problem)
        train, test = stored(train), stored(test)
        models = M.train_models(train, problem)
        M.save_models(models, problem, tmp_dir)
        back = M.load_models(spark, problem, tmp_dir)
        assert list(back) == list(models)
        rows = [sorted(map(tuple, M.predictions(x, test, problem)[0].collect())) for x in (models, back)]
        assert rows[0] == rows[1] and len(rows[0]) == 3 * test.count()
        if problem == "regression":
            linear = models["LinearRegression"]
            scaled = [f"scaled_{c}" for c in cols]
            *weights, intercept = M.solve_linear(M.normal_equations(M.feature_rows(train, cols), scaled), len(cols))
            x = np.array([[r[c] for c in scaled] for r in M.feature_rows(test, cols).collect()])
            ours, theirs = x @ np.array(weights) + intercept, x @ linear.coefficients.toArray() + linear.intercept
            assert np.allclose(ours, theirs, atol=1e-6)


def test_a_failing_model_is_a_row_of_its_own(spark, tmp_dir):
    modeling = stored(R.modeling_dataset(B.rides(spark, SF)))
    train, test, _, _ = M.prepare_features(modeling, "regression")
    models = M.load_models(spark, "regression", tmp_dir)  # nothing was saved there
    assert all(isinstance(m, M.FailedModel) for m in models.values())
    rows = M.evaluate_models(models, test, "regression").collect()
    assert len(rows) == 9 and all(r.value is None and r.error for r in rows)
    assert M.model_facts(models, "regression", train).count() == 3


# ---------------------------------------------------------------- files
def _bytes(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_feed_is_read_once_in_either_encoding(spark, tmp_dir):
    text = 'stop_id,Stop Name,stop_lat,größe\n1,"Süd, ""alt""",1.5,x\n2,Öst,NA,y\n'
    for name, data, encoding in (("a", text.encode("utf-8-sig"), "UTF-8"), ("b", text.encode("iso-8859-1"), "ISO-8859-1"),
                                 ("c", b"stop_id,stop_name,stop_lat\n1,plain,1\n2,bad,x\n", "UTF-8")):
        path = os.path.join(tmp_dir, f"{name}.txt")
        _bytes(path, data)
        feed = FD.store_feed(spark, path, "stops")
        os.replace(path, path + ".gone")  # nothing below reads the file again
        rows = feed.df.orderBy("stop_id").collect()
        assert (feed.encoding, feed.rows, len(rows)) == (encoding, 2, 2)
        if name == "c":
            assert feed.rejects == {"stop_lat": 1} and [r.stop_lat for r in rows] == ["1", "x"]
        else:
            assert feed.df.columns == ["stop_id", "stop_name", "stop_lat", "größe"] and rows[0].stop_name == 'Süd, "alt"'
            assert [r.stop_lat for r in rows] == [1.5, None] and rows[1].stop_name == "Öst"


def test_empty_and_missing_files_are_told_apart(spark, tmp_dir):
    _bytes(f"{tmp_dir}/c/routes.txt", b"route_id\n1\n")
    _bytes(f"{tmp_dir}/c/trips.txt", b"")
    status = {r.file_name: r.status for r in FD.feed_completeness(spark, tmp_dir, ["c"], ["routes.txt", "trips.txt", "stops.txt"]).collect()}
    assert status == {"routes.txt": "present", "trips.txt": "empty", "stops.txt": "missing"}


def test_reload_leaves_the_other_city_alone(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    ST.write_table(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "city string, x int"), path)

    def files(city):
        return {(f, os.stat(f"{path}/city={city}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/city={city}")}
    kept, old = files("b"), files("a")
    ST.write_table(spark.createDataFrame([("a", 9)], "city string, x int"), path)
    assert files("b") == kept and files("a") != old
    assert sorted(map(tuple, spark.read.parquet(path).select("city", "x").collect())) == [("a", 9), ("b", 3)]


def test_written_results_are_in_order_over_files(spark, tmp_dir):
    rows = [(f"r{i}", "a" if i % 3 else "b", (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "route_id string, city string, num_trips long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many files as a large result has
    J.write_ordered({"route_stats": df}, tmp_dir)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = [(r.city, -r.num_trips, r.route_id) for r in ST.written_order(spark, f"{tmp_dir}/route_stats").orderBy("place").collect()]
    assert got == sorted(got) and len(got) == 3000
    assert len([f for f in os.listdir(f"{tmp_dir}/route_stats") if f.endswith(".parquet")]) > 1


def test_rule_metrics_cover_both_cities(spark):
    got = {(r.city, r.metric) for r in queries()["rule_classification_metrics"](spark, SF).collect()}
    assert got == {(c, m) for c in B.CITIES for m in ("AUC", "Accuracy", "F1")}
