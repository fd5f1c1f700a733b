"""Surge models with Spark ML.

The modelling table is the per (city, hour, weekend) feature table, so it
has at most cities x 24 x 2 rows; training is Spark ML's own distributed
fitting. Differences from a naive pipeline, on purpose:

- the split is a hash of the row key (stable under repartitioning and
  re-execution), not ``randomSplit``;
- the indexer and scaler are fitted on the training rows only, then applied
  to both sides;
- every estimator gets an explicit seed.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis import constants as K
from mobilis.operators.metrics import classification_metrics, regression_metrics
from mobilis.operators.rides import surge_label
from mobilis.session import scratch_path

SEED = 42
#: The class that loads each saved model.
SAVED = {
    "LinearRegression": LinearRegressionModel, "RandomForestRegressor": RandomForestRegressionModel,
    "GradientBoostingRegressor": GBTRegressionModel, "LogisticRegression": LogisticRegressionModel,
    "RandomForestClassifier": RandomForestClassificationModel, "GradientBoostingClassifier": GBTClassificationModel,
}
KEY_COLUMNS = ["city", "hour_of_day", "is_weekend"]


def split_data(df: DataFrame, train_ratio: float = 0.8, seed: int = SEED,
               key_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Deterministic split: a row is in train when hash(seed, key) mod 1000 < ratio * 1000.

    The hash is the first 32 bits of the MD5 of the seed and the key as text, joined by ``|``.
    """
    keys = [c for c in (key_columns or KEY_COLUMNS) if c in df.columns]
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % 1000
    marked = df.withColumn("_split", bucket < int(round(train_ratio * 1000)))
    return (marked.where(F.col("_split")).drop("_split"), marked.where(~F.col("_split")).drop("_split"))


def feature_pipeline(feature_cols: list[str] | None = None) -> Pipeline:
    """City index (unknown kept) + numerics -> vector (invalid kept) -> scaled by std, not centred."""
    cols = list(feature_cols or K.MODEL_FEATURES)
    return Pipeline(stages=[
        StringIndexer(inputCol="city", outputCol="city_index", handleInvalid="keep"),
        VectorAssembler(inputCols=cols + ["city_index"], outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="scaled_features", withStd=True, withMean=False),
    ])


def prepare_features(modeling: DataFrame, problem_type: str = "regression", train_ratio: float = 0.8,
                     seed: int = SEED) -> tuple[DataFrame, DataFrame, PipelineModel, list[str]]:
    """Label, split, fit the feature pipeline on train, transform both sides.

    Returns (train, test, fitted pipeline, feature names in vector order).
    """
    labelled = surge_label(modeling, problem_type)
    train, test = split_data(labelled, train_ratio, seed)
    fitted = feature_pipeline().fit(train)
    return fitted.transform(train), fitted.transform(test), fitted, K.MODEL_FEATURES + ["city_index"]


def estimators(problem_type: str) -> dict:
    common = {"featuresCol": "scaled_features", "labelCol": "label"}
    if problem_type == "regression":
        return {
            "LinearRegression": LinearRegression(maxIter=50, **common),
            "RandomForestRegressor": RandomForestRegressor(numTrees=50, maxDepth=8, seed=SEED, **common),
            "GradientBoostingRegressor": GBTRegressor(maxIter=50, maxDepth=6, seed=SEED, **common),
        }
    return {
        "LogisticRegression": LogisticRegression(maxIter=50, **common),
        "RandomForestClassifier": RandomForestClassifier(numTrees=50, maxDepth=8, seed=SEED, **common),
        "GradientBoostingClassifier": GBTClassifier(maxIter=50, maxDepth=6, seed=SEED, **common),
    }


@dataclass(frozen=True)
class FailedModel:
    """Stands for an estimator that could not be fitted (a single-class label, for example)."""

    error: str


def _message(error: Exception) -> str:
    return str(error).split("\n", 1)[0][:300]


def train_models(train: DataFrame, problem_type: str = "regression") -> dict:
    """Each estimator's name with its fitted model, or a FailedModel that says why there is none."""
    def fitted(estimator):
        try:
            return estimator.fit(train)
        except (PySparkException, Py4JError) as e:
            return FailedModel(_message(e))
    return {name: fitted(est) for name, est in estimators(problem_type).items()}


def predictions(models: dict, data: DataFrame, problem_type: str = "regression") -> tuple[DataFrame | None, dict[str, str]]:
    """(model, keys..., label, prediction, score) of every row and model that can score it, and the errors of the others.

    Each model's rows are written before the next is asked, so that one that
    fails does so alone. ``score`` is the raw score of label 1 in
    classification, else the prediction.
    """
    spark, parts, errors = data.sparkSession, [], {}
    keys = [c for c in KEY_COLUMNS if c in data.columns]
    for name, model in models.items():
        if isinstance(model, FailedModel):
            errors[name] = model.error
            continue
        path = scratch_path(spark, f"predictions-{name}")
        try:
            rows = model.transform(data)
            score = F.col("prediction") if problem_type == "regression" else vector_to_array("rawPrediction")[1]
            rows.select(F.lit(name).alias("model"), *keys, "label", "prediction", score.alias("score")).write.parquet(path)
            parts.append(spark.read.parquet(path))
        except (PySparkException, Py4JError) as e:
            errors[name] = _message(e)
    return (reduce(DataFrame.unionByName, parts) if parts else None), errors


METRICS = {"regression": ["RMSE", "MAE", "R2"], "classification": ["AUC", "Accuracy", "F1"]}


def evaluate_models(models: dict, test: DataFrame, problem_type: str = "regression") -> DataFrame:
    """(model, metric, value, error) rows from stored predictions; where there is no value, the error says why."""
    scored, errors = predictions(models, test, problem_type)
    measure = regression_metrics if problem_type == "regression" else classification_metrics
    failed = [(name, metric, None, error) for name, error in errors.items() for metric in METRICS[problem_type]]
    out = test.sparkSession.createDataFrame(failed, "model string, metric string, value double, error string")
    return out if scored is None else measure(scored, ["model"]).withColumn("error", F.lit(None).cast("string")).unionByName(out)


def model_facts(models: dict, problem_type: str, train: DataFrame) -> DataFrame:
    """One row per estimator: features, trees, coefficients, a metric on the training rows, and the error if it failed."""
    metric = METRICS[problem_type][0]
    rows = [(name, problem_type, None if isinstance(m, FailedModel) else int(m.numFeatures), getattr(m, "getNumTrees", None),
             None if not hasattr(m, "coefficients") else len(m.coefficients)) for name, m in models.items()]
    facts = train.sparkSession.createDataFrame(rows, "model string, problem_type string, n_features int, n_trees int, n_coefficients int")
    scores = evaluate_models(models, train, problem_type).where(F.col("metric") == metric)
    return facts.join(scores.withColumn("metric", F.concat(F.lit("train_"), "metric")), "model")


def save_models(models: dict, problem_type: str, root: str) -> list[str]:
    """Overwrite each fitted model under ``{root}/{problem_type}_{name}``."""
    paths = []
    for name, model in models.items():
        if isinstance(model, FailedModel):
            continue
        path = f"{root.rstrip('/')}/{problem_type}_{name.lower()}"
        model.write().overwrite().save(path)
        paths.append(path)
    return paths


def load_models(spark: SparkSession, problem_type: str, root: str) -> dict:
    """The models that ``save_models`` left under ``root``, in training order; a missing one is a FailedModel."""
    out = {}
    for name in estimators(problem_type):
        path = f"{root.rstrip('/')}/{problem_type}_{name.lower()}"
        try:
            out[name] = SAVED[name].load(path)
        except (PySparkException, Py4JError) as e:
            out[name] = FailedModel(_message(e))
    return out


def model_comparison(results: DataFrame, problem_type: str) -> DataFrame:
    """Evaluation rows tagged with the problem type and the run time."""
    now = datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
    return results.select(F.lit(now).alias("timestamp"), F.lit(problem_type).alias("problem_type"), "*")


def feature_importance(models: dict, feature_cols: list[str]) -> DataFrame | None:
    """Tree models only: (model, position in training order, feature, score, rank) with rank 1 = most important."""
    rows = []
    for position, (name, model) in enumerate(models.items()):
        if not hasattr(model, "featureImportances"):
            continue
        scores = model.featureImportances.toArray().tolist()
        pairs = sorted(zip(feature_cols, scores), key=lambda p: -p[1])
        rows.extend((name, position, f, float(s), i + 1) for i, (f, s) in enumerate(pairs))
    if not rows:
        return None
    return SparkSession.getActiveSession().createDataFrame(
        rows, "model string, position int, feature string, score double, rank int")


def model_insights(modeling: DataFrame, importance: DataFrame | None, problem_type: str,
                   top: int = 5) -> dict[str, DataFrame]:
    """Top features of every tree model, the recommendation that names the leading model's, and the per-city surge summary.

    ``leading`` marks the first tree model in training order.
    """
    out = {}
    if importance is not None:
        first = importance.agg(F.min("position").alias("_first"))
        best = (importance.where(F.col("rank") <= top).crossJoin(F.broadcast(first))  # one row
                .select("model", (F.col("position") == F.col("_first")).alias("leading"), "feature", "score", "rank",
                        F.lit(problem_type).alias("problem_type")))
        out["top_features"] = best
        names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"])
        out["recommendations"] = best.where("leading").groupBy("problem_type").agg(
            F.concat(F.lit(K.TEXT_TOP_FEATURES), F.array_join(names, ", ")).alias("recommendation"))
    out["city_summary"] = modeling.groupBy("city").agg(
        F.avg("avg_surge_multiplier").alias("avg_surge_multiplier"), F.sum("ride_count").alias("ride_count"))
    return out


def feature_rows(processed: DataFrame, names: list[str]) -> DataFrame:
    """Processed rows with one column per scaled feature."""
    values = vector_to_array("scaled_features")
    return processed.select(*[c for c in KEY_COLUMNS if c in processed.columns], "label",
                            *[values[i].alias(f"scaled_{n}") for i, n in enumerate(names)])


def normal_equations(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(i, j, mean_product) of the features, the constant 1 and the label: all that a linear fit reads of the rows.

    One aggregate of products, whatever the number of rows; its result merges
    over partitions like any sum. The last place is the label, the one before
    it the constant.
    """
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0), F.col(label).cast("double")]
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    one = rows.agg(*[F.avg(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in cells])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("mean_product"))
                                          for i, j in cells])).alias("x")).select("x.*")


def solve_linear(equations: DataFrame, n_features: int) -> list[float]:
    """Coefficients and intercept of least squares; of features that depend on others the smallest ones.

    A matrix of (features + 2) squared numbers is solved on the driver.
    """
    import numpy as np

    size = n_features + 2
    m = np.zeros((size, size))
    for r in equations.collect():
        m[r.i, r.j] = m[r.j, r.i] = r.mean_product
    mean, means = m[-2, -1], m[-2, :-2]
    centred = m[:-2, :-2] - np.outer(means, means)
    weights = np.linalg.lstsq(centred, m[:-2, -1] - means * mean, rcond=1e-12)[0]
    return [*weights.tolist(), float(mean - means @ weights)]
