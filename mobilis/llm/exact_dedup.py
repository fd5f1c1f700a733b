"""Exact deduplication by a tree merge of sorted digest runs.

Rows are dealt to runs by a hash of their id. Each run keeps one record per
digest, sorted by digest: (digest, verification values, kept id, count). Rounds
then merge ``fan`` neighbouring runs into one until a single run is left; each
round keeps the surviving id of a digest and adds up counts. A hot digest is
one record per run from the first step on, so no task ever sees its copies
together, and the answer travels back to rows by (run, digest), where copies
of a hot digest are again spread over all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilis.llm.common import shuffle_partitions, stored

FAN = 8
#: What two texts must share to count as equal: SHA-256, length and a second, unrelated hash.
RECORD = ["text_sha256", "n_bytes", "check"]


def digests(docs: DataFrame, runs: int, text: Column | None = None) -> DataFrame:
    """(doc_id, run, text_sha256, n_bytes, check) per row, sorted by digest inside each run."""
    value = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    rows = docs.select(F.col("doc_id"), value.alias("_t")).select(
        "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"),
        F.sha2("_t", 256).alias("text_sha256"), F.octet_length("_t").alias("n_bytes"), F.xxhash64("_t").alias("check"))
    return rows.repartition(runs, "run").sortWithinPartitions("run", "text_sha256")


def merge_runs(rows: DataFrame, runs: int, keep: str = "max", fan: int = FAN) -> DataFrame:
    """(digest, keep_id, group_size) from the rounds of merging."""
    best = F.max if keep == "max" else F.min
    tree = rows.groupBy("run", *RECORD).agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    while runs > 1:
        runs = -(-runs // fan)
        tree = (tree.groupBy(F.floor(F.col("run") / fan).cast("int").alias("run"), *RECORD)
                .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    return tree.drop("run")


def exact_dedup(docs: DataFrame, keep: str = "max", runs: int | None = None, fan: int = FAN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs doc_id and text; further columns are ignored whatever their
    names. Texts are equal when identical without any change; null counts as
    the empty text. Of equal texts the row with the largest (``keep="min"``:
    smallest) doc_id stays. Null ids lose against any id; in a group of only
    null ids all are kept. A repeated row (same id, same text) is the same
    document: its copies get the same answer and count in group_size. An empty
    table gives an empty result.
    """
    runs = runs or shuffle_partitions(docs.sparkSession)
    rows = stored(digests(docs, runs), "digest-runs")
    answer = merge_runs(rows, runs, keep, fan)
    # The answer reaches each run once per digest, then the rows of that run.
    per_run = rows.select("run", *RECORD).distinct().join(answer, RECORD)
    return (rows.join(per_run, ["run", *RECORD])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))
