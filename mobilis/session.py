"""Session options the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Options every job wants: UTC session clock (ride timestamps are naive local
# times), adaptive execution with skew-join splitting, dynamic partition
# overwrite for per-city tables. Coalesced shuffle partitions may go down to
# 256 KB: several stages (sketches, windows over distinct values) are heavy
# per byte, and a few-MB shuffle should still use every core.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "mobilis", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        # Adaptive execution starts from this many and only merges, so a large job sets it high.
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none and runs on a ``local`` master (tests) do
    we pick a scratch folder; any other master without one is an error, since
    executors would not share a folder of the driver's machine. A session without a SparkContext handle (a remote client) manages its
    checkpoint folder on the server; its configured value is returned.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions expose no SparkContext
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="mobilis-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    return checkpoint_root(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a shared folder")
    return f"{root.rstrip('/')}/tables/{name}-{os.getpid()}-{next(_counter)}"


def _count():
    n = 0
    while True:
        n += 1
        yield n


_counter = _count()
