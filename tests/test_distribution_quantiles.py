"""Histograms follow numpy; exact quantiles follow pandas; both on skewed data."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from mobilis.operators.distribution import box_stats, histogram
from mobilis.operators import quantiles
from mobilis.operators.quantiles import column_quantiles


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 40, 500), [40] * 200, rng.normal(10, 3, 300).round(3)])
    df = spark.createDataFrame(pd.DataFrame({"v": vals.astype(float)}))
    for bins in (7, 20, 30):
        got = [r["count"] for r in histogram(df, "v", bins, keys=[]).orderBy("bin").collect()]
        ref, _ = np.histogram(vals, bins=bins)
        assert got == ref.tolist()


def test_histogram_single_value_and_top_edge(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    got = histogram(df, "v", 30, keys=[]).where("count > 0").collect()
    ref, _ = np.histogram([5.0, 5.0], bins=30)
    assert [(r.bin, r["count"]) for r in got] == [(int(np.argmax(ref)), 2)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=200))
def test_quantiles_property(spark, values):
    df = spark.createDataFrame([(float(v), v) for v in values], "v double, i int")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r.column_name, r.p): r.quantile for r in column_quantiles(df, ["v", "i"], probs).collect()}
    s = pd.Series(values, dtype=float)
    for p in probs:
        assert abs(got["v", p] - s.quantile(p)) < 1e-9 and abs(got["i", p] - s.quantile(p)) < 1e-9


def test_quantiles_with_coarse_sketches(spark, monkeypatch):
    # bounds far apart and close together, hot values, nulls and NaN
    rng = np.random.default_rng(3)
    vals = [1.0] * 3000 + rng.normal(5, 2, 4000).tolist() + [None] * 5 + [float("nan")] * 5
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(7)
    s = pd.Series(vals, dtype=float).dropna()
    for size, margin in ((8, 2.0), (8, 0.001), (64, 0.1), (1024, 2.0)):  # too tight bounds are moved apart
        monkeypatch.setattr(quantiles, "SKETCH", size)
        monkeypatch.setattr(quantiles, "MARGIN", margin)
        got = {r.p: r.quantile for r in column_quantiles(df, ["v"], [0.01, 0.25, 0.5, 0.9]).collect()}
        assert all(abs(got[p] - s.quantile(p)) < 1e-9 for p in got) and len(got) == 4


def test_quantiles_keep_long_ids_apart(spark):
    df = spark.createDataFrame([(9007199254740992,), (9007199254740993,), (9007199254740994,)], "id long")
    assert df.select("id").distinct().count() == 3
    assert column_quantiles(df, ["id"], [0.5]).first().quantile == float(9007199254740993)


def test_box_fence_value_not_outlier(spark):
    # q1 = 1, q3 = 3 -> fences -2 and 6; 6 sits on the fence, 7 is outside
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 3, 3, 3, 6, 7]], "v double")
    b = box_stats(df, "v", keys=[]).first()
    s = pd.Series([1, 1, 1, 3, 3, 3, 6, 7], dtype=float)
    assert (b.q1, b.q3) == (s.quantile(0.25), s.quantile(0.75))
    lo, hi = b.q1 - 1.5 * b.iqr, b.q3 + 1.5 * b.iqr
    assert b.outliers == int(((s < lo) | (s > hi)).sum())
