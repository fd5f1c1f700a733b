"""Host-level quality rules.

Every document gets its base measures from one pass of array expressions over
its text. Failures are then added up per host, the rate of a host is shrunk
towards the corpus by a beta prior fitted to all hosts (method of moments),
and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilis.llm.common import BLANKS, let, stored, words

#: Words of a window whose repetition counts.
WINDOW = 8
MIN_WORDS = 20
#: A host is rejected when its shrunk rate of failing documents is above this.
MAX_HOST_RATE = 0.5
SYMBOLS = r"[#*$%&|<>]"
#: Bounds of the prior's weight (alpha + beta), in documents.
MIN_WEIGHT, MAX_WEIGHT = 2.0, 1000.0


def _pairs(hashes: Column, step: int) -> Column:
    """Combines each element with the one ``step`` later; ``step`` elements shorter."""
    n = F.size(hashes) - step
    return F.when(n > 0, F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))
                  ).otherwise(F.array().cast("array<bigint>"))


def window_hashes(ws: Column) -> Column:
    """A 64-bit hash of every window of 8 words: words are combined to pairs, fours, eights."""
    one = F.transform(ws, lambda w: F.xxhash64(w))
    return let(one, lambda a: let(_pairs(a, 1), lambda b: let(_pairs(b, 2), lambda c: _pairs(c, 4))))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs more than once, each word once."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        at = F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"]))
        return F.array_sort(F.filter(at, lambda i: i.isNotNull()))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
    return let(ranked, lambda s: F.aggregate(positions(s), start, step, lambda acc: acc["n"]))


def repeated_words(ws: Column) -> Column:
    found = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long"))
    return let(window_hashes(ws), found)


def _by_words(ws: Column) -> Column:
    return F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                    repeated_words(ws).alias("n_repeat_words"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and the base measures of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    return (docs.select("doc_id", F.col("source").alias("host"), text.alias("_t"))
            .select("doc_id", "host", let(words(F.col("_t")), _by_words).alias("_w"),
                    (F.octet_length("_t") - F.octet_length(F.regexp_replace("_t", SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
                    let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                                  (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"))
            .select("doc_id", "host", "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
            .withColumn("failed", F.col("base_failed") | (10 * F.col("n_symbols") > F.col("word_chars"))
                        | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))))


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), host_rejected.

    The prior has the corpus rate as its mean; its weight is what the method of
    moments gives for the spread of the hosts' own rates, within MIN_WEIGHT and
    MAX_WEIGHT documents.
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("failed").alias("n_failed"))
    own = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.var_samp(own).alias("v"))
    weight = F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(MAX_WEIGHT)
    prior = prior.select("m", F.greatest(F.lit(MIN_WEIGHT), F.least(F.lit(MAX_WEIGHT), weight)).alias("w"))
    mean, size = prior.select("m").scalar(), prior.select("w").scalar()
    rate = (F.col("n_failed") + mean * size) / (F.col("n_docs") + size)
    return hosts.withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > MAX_HOST_RATE)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, host, base measures, base_failed, host rate, kept.

    ``docs`` needs doc_id, text and source (the host); other columns are ignored
    whatever their names. Null text counts as empty (no words: base_failed).
    Rows without a host form one host of their own. A row is kept unless it
    fails a base rule or its host's shrunk rate of failures is above
    MAX_HOST_RATE. Repeated rows are judged one by one. An empty table gives an
    empty result.
    """
    rows = stored(measures(docs), "quality-measures")
    # Rows and hosts meet by host and a salt, so a hot host is spread over all tasks.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    verdicts = (host_rates(rows).select("host", "rate", "host_rejected")
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    joined = rows.withColumn("salt", salt).alias("r").join(
        verdicts.alias("v"), F.col("r.host").eqNullSafe(F.col("v.host")) & (F.col("r.salt") == F.col("v.salt")))
    return joined.select("r.doc_id", "r.host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", F.col("rate").alias("host_rate"),
                         (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


#: Parts into which each host's rows are dealt for the join with its verdict.
SALTS = 16
