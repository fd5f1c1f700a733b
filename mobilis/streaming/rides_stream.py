"""Incremental scoring of ride files with the batch scoring operators.

Every operator in ``operators.scoring`` is per-row (plus stream-static joins
against the fixed lookup tables), so it applies unchanged to a streaming
DataFrame. The sink appends Parquet and keeps its progress in a checkpoint
folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mobilis.operators.rides import preprocess_rides
from mobilis.operators.scoring import score_rides
from mobilis.schemas import RIDES_SCHEMA


def read_ride_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet", schema=None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Ride files dropped into ``source_dir`` as a streaming DataFrame (schema is fixed)."""
    reader = spark.readStream.schema(schema or _flat_schema(RIDES_SCHEMA)).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir)


def _flat_schema(schema):
    """Stored ride files keep the scalar columns; the demand struct is recomputed."""
    from pyspark.sql import types as T
    return T.StructType([f for f in schema.fields if f.name != "demand_features"])


def scored_ride_stream(rides: DataFrame) -> DataFrame:
    """Prepared (time features, ratios, outlier filter) and scored rides."""
    return score_rides(preprocess_rides(rides))


def start_scoring(rides: DataFrame, out_dir: str, checkpoint_dir: str,
                  available_now: bool = True) -> StreamingQuery:
    """Append scored rides to Parquet; ``available_now`` drains what is there and stops."""
    w = (scored_ride_stream(rides).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out_dir)


def start_features(rides: DataFrame, table_dir: str, checkpoint_dir: str,
                   available_now: bool = True) -> StreamingQuery:
    """Keep the per (city, hour_of_day, is_weekend) ride features current as files arrive.

    A streaming aggregation in complete mode: its state has one entry per
    key, at most cities x 24 x 2, however many rides arrive. Each micro-batch
    replaces the feature table (``foreachBatch``), so readers always see the
    whole, current table.
    """
    from mobilis.operators.rides import ride_features

    def replace(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(table_dir)

    w = (ride_features(rides).writeStream.outputMode("complete").foreachBatch(replace)
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
