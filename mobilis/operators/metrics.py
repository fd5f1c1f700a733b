"""Model metrics from stored predictions, by plain aggregates and distributed ranks.

A predictions table has one row per scored row: label, prediction and, for
classification, score (any number that grows with the belief in label 1),
and any key columns (the model, say), for each of which the metrics are
computed. Rows with a null in a used column are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.operators.common import side_by_side
from mobilis.session import scratch_path


def _rows(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return wide.unpivot(keys, names, "metric", "value") if keys else wide.withColumn("_k", F.lit(0)).unpivot(["_k"], names, "metric", "value").drop("_k")


def regression_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., metric, value): RMSE, MAE and R2 (against the mean label), in one aggregate.

    R2 is null where all labels are equal.
    """
    error = F.col("prediction") - F.col("label")
    rows = predictions.where(error.isNotNull()).groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("RMSE"), F.avg(F.abs(error)).alias("MAE"),
        F.avg(error * error).alias("_e"), F.var_pop("label").alias("_v"))
    rows = rows.withColumn("R2", F.lit(1.0) - F.try_divide(F.col("_e"), F.col("_v"))).drop("_e", "_v")
    return _rows(rows, keys, ["RMSE", "MAE", "R2"])


def classification_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., metric, value): AUC, Accuracy and F1 (of each label, weighted by its rows)."""
    return _rows(side_by_side([auc(predictions, keys), accuracy_f1(predictions, keys)], keys), keys, ["AUC", "Accuracy", "F1"])


def accuracy_f1(predictions: DataFrame, keys: list[str]) -> DataFrame:
    rows = predictions.where("label is not null and prediction is not null")
    cells = rows.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hits = cells.where("label = prediction").select(*keys, F.col("label").alias("_l"), F.col("n").alias("hit"))
    of_label = cells.groupBy(*keys, F.col("label").alias("_l")).agg(F.sum("n").alias("labelled"))
    of_prediction = cells.groupBy(*keys, F.col("prediction").alias("_l")).agg(F.sum("n").alias("predicted"))
    # A few labels a key from here on.
    each = of_label.unionByName(of_prediction, True).unionByName(hits, True).groupBy(*keys, "_l").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("labelled", "predicted", "hit")])
    f1 = 2 * F.col("hit") / (F.col("labelled") + F.col("predicted"))
    return each.groupBy(*keys).agg((F.sum("hit") / F.sum("labelled")).alias("Accuracy"),
                                   (F.sum(f1 * F.col("labelled")) / F.sum("labelled")).alias("F1"))


def auc(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., AUC): the share of pairs of a label 1 and another row in which the former has the higher score; ties are halves.

    Equal scores are one cell with two counts. Cells are range-sorted over
    partitions; what lies below a cell is summed inside its partition and
    added to the totals of the partitions before, one row a key and partition.
    """
    positive = F.col("label") == 1
    cells = predictions.where("label is not null and score is not null").groupBy(*keys, "score").agg(
        F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    # Stored, so that both uses below see the same partitions.
    path = scratch_path(predictions.sparkSession, "score-cells")
    cells = cells.repartitionByRange(*keys, "score").withColumn("_part", F.spark_partition_id())
    cells.write.parquet(path)
    cells = predictions.sparkSession.read.schema(cells.schema).parquet(path)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cells.groupBy(*keys, "_part").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    lower = Window.partitionBy(*keys, "_part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inside = cells.withColumn("_below", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    won = F.col("p") * (F.col("_before") + F.col("_below") + F.col("n") / F.lit(2.0))
    return inside.join(parts, [*keys, "_part"]).groupBy(*keys).agg(F.try_divide(F.sum(won), F.sum("p") * F.sum("n")).alias("AUC"))


def binary_predictions(df: DataFrame, label: Column, score: Column, threshold: float, keys: list[str]) -> DataFrame:
    """A predictions table: prediction is 1 where the score is above the threshold."""
    return df.select(*keys, label.cast("double").alias("label"), score.alias("score"), F.when(score > threshold, 1.0).otherwise(0.0).alias("prediction"))
