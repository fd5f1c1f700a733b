"""Table profiles: size, duplicates, numeric statistics, missing values, quality issues.

Each function takes ``{table_name: DataFrame}`` and returns one long table
covering all of them (a union of one aggregate per table), so a whole feed
is profiled in one job. "Numeric" means integral, floating or decimal
columns; text columns are the string ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mobilis.constants import WEEKDAY_COLUMNS
from mobilis.operators.quantiles import Scanned, outliers, quantiles, scan, usable
from mobilis.session import scratch_path

KEYS = ["table_name", "column_name"]
#: Distance of the outlier fences from the quartiles, in interquartile ranges.
FENCES = 1.5
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _row_hash(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, nulls told apart from values by position."""
    cells = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*cells).alias("_h1"), F.xxhash64(F.lit("second"), *reversed(cells)).alias("_h2")]


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and duplicate rows beyond the first, per table.

    Rows are grouped by a 128-bit hash of all their columns, so the shuffle is
    as narrow for a wide table; repeated rows collapse before it.
    """
    parts = []
    for name, df in tables.items():
        g = df.select(*_row_hash(df)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_k"))
        parts.append(g.agg(F.sum("_k").alias("n_rows"), F.sum(F.col("_k") - 1).alias("duplicates"))
                      .select(F.lit(name).alias("table_name"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                              F.lit(len(df.columns)).alias("n_columns"),
                              F.coalesce("duplicates", F.lit(0)).alias("duplicates")))
    return _union(parts)


def table_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, data_type) per column."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in tables.items()
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")



def _per_column(df: DataFrame, table: str, aggregates: dict[str, Callable[[str], Column]]) -> DataFrame:
    """(table_name, column_name, one column per aggregate) over the numeric columns, from one aggregate row."""
    columns = numeric_columns(df)
    values = df.select(*[usable(df, c).alias(c) for c in columns])
    one = values.agg(*[F.struct(*[f(c).alias(n) for n, f in aggregates.items()]).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), *[F.col(f"`{c}`.{n}").alias(n) for n in aggregates])
                     for c in columns])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def _numeric(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    return {t: numeric_columns(df) for t, df in tables.items()}


def _by_name(found: Scanned, probs: dict[str, float]) -> DataFrame:
    """(table_name, column_name, one column per quantile)."""
    q = quantiles(found, list(probs.values()))
    return q.groupBy(*KEYS).agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name) for name, p in probs.items()])


def numeric_stats(tables: dict[str, DataFrame]) -> DataFrame | None:
    """count, mean, sample std, min, 25/50/75% (linear), max per numeric column with a value; two scans a table."""
    if not any(_numeric(tables).values()):
        return None
    spark = next(iter(tables.values())).sparkSession
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = scan(tables, _numeric(tables), list(probs.values()))
    rows = [(r.table_name, r.column_name, r.n, r.mean, r.std, float(r.leastl if r.whole else r.leastd), float(r.mostl if r.whole else r.mostd))
            for r in (found.stats if found else [])]
    plain = spark.createDataFrame(rows, "table_name string, column_name string, n bigint, mean double, std double, min_value double, max_value double")
    if found is None:
        return plain.select(*KEYS, "n", "mean", "std", "min_value", *[F.lit(None).cast("double").alias(q) for q in probs], "max_value")
    # One row a column on either side.
    return (plain.join(F.broadcast(_by_name(found, probs)), KEYS)
            .select(*KEYS, "n", "mean", "std", "min_value", "q25", "q50", "q75", "max_value"))


def missing_values(tables: dict[str, DataFrame]) -> DataFrame:
    """Per column with any missing value: count and percent of rows (NaN counts as missing)."""
    parts = []
    for t, df in tables.items():
        def miss(f):
            c = F.col(f.name)
            test = c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.isNull()
            return F.count_if(test).alias(f.name)
        counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[miss(f) for f in df.schema.fields])
        cols = [f.name for f in df.schema.fields]
        parts.append(counts.unpivot(["_rows"], cols, "column_name", "missing")
                           .select(F.lit(t).alias("table_name"), "column_name", "missing",
                                   (F.col("missing") / F.col("_rows") * 100).alias("missing_pct")))
    return _union(parts).where(F.col("missing") > 0)


def missing_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Total missing cells and the number of columns with any, per table."""
    return missing_values(tables).groupBy("table_name").agg(
        F.sum("missing").alias("total_missing"), F.count(F.lit(1)).alias("columns_with_missing"))


def sign_issues(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(table_name, column_name, issue, count) of negative_values and zero_values, one aggregate per table."""
    parts = [_per_column(df, t, {
        "negative_values": lambda c: F.count_if(F.col(c) < 0),
        "zero_values": lambda c: F.count_if((F.col(c) == 0) & F.lit(c.lower() not in WEEKDAY_COLUMNS))})
        for t, df in tables.items() if numeric_columns(df)]
    if not parts:
        return None
    return _union(parts).unpivot(KEYS, ["negative_values", "zero_values"], "issue", "count").where(F.col("count") > 0)


def outlier_issues(tables: dict[str, DataFrame]) -> DataFrame | None:
    """The same for outliers: values outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR; a value on the fence is none. Two scans a table."""
    if not any(_numeric(tables).values()):
        return None
    found = scan(tables, _numeric(tables), [0.25, 0.75], FENCES)
    if found is None:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table_name string, column_name string, issue string, count bigint")
    counted = outliers(found, _by_name(found, {"q1": 0.25, "q3": 0.75}), FENCES)
    return counted.select(*KEYS, F.lit("outliers").alias("issue"), F.col("outliers").alias("count")).where(F.col("count") > 0)


def quality_issues(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(table_name, column_name, issue, count) for counts > 0.

    issues: negative_values (< 0), zero_values (= 0, weekday flag columns
    skipped) and outliers (quartiles are exact and linear).
    """
    signs = sign_issues(tables)
    return None if signs is None else signs.unionByName(outlier_issues(tables))


#: Values a text column's summary keeps counters for.
TRACKED = 10_000


def heavy_hitters(tables: dict[str, DataFrame], k: int, tracked: int = TRACKED) -> tuple[DataFrame, DataFrame]:
    """What one scan with bounded counters says about the top k values of text columns.

    The first result has a row per column: table_name, column_name, n (rows), error (what a counter may be off) and ``known``: ``all`` when
    every value has a counter that is exact, ``top`` when the top k are among
    the values of the second result, ``none`` when the counters do not tell
    them from the rest. The second one has (table_name, column_name, value,
    estimate): all values of the former columns, the candidates of the latter.

    A summary of m counters is off by at most 3.5 / m of the rows, however its
    parts were merged, and lists every value that occurs more than twice that
    often. A table with at most ``tracked`` rows never loses one.
    """
    parts = []
    for t, df in tables.items():
        cols = text_columns(df)
        if not cols:
            continue
        # Nulls take part in the summary, so its error follows all rows.
        one = df.agg(*[F.struct(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{c}`, {tracked}, {tracked})").alias("items")).alias(c) for c in cols])
        rows = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"`{c}`.n").alias("n"),
                                  F.col(f"`{c}`.items").alias("items")) for c in cols])
        parts.append(one.select(F.explode(rows).alias("x")).select("x.*"))
    summaries = _union(parts)
    path = scratch_path(summaries.sparkSession, "heavy-hitters")
    summaries.write.parquet(path)
    summaries = summaries.sparkSession.read.schema(summaries.schema).parquet(path)
    summaries = summaries.withColumn("items", F.filter("items", lambda x: x["item"].isNotNull()))
    # The table of counters has at least tracked / 0.75 places.
    error = F.when(F.col("n") <= tracked, 0).otherwise(F.ceil(F.col("n") * (3.5 * 0.75 / tracked)))
    counts = F.array_sort(F.transform("items", lambda x: -x["count"]))
    kth = F.when(F.size("items") >= k, -F.get(counts, F.lit(k - 1)))
    judged = summaries.withColumn("error", error).withColumn("kth", kth).withColumn(
        "known", F.when(F.col("n") <= tracked, "all").when(F.col("kth") > 3 * F.col("error"), "top").otherwise("none"))
    items = judged.where("known <> 'none'").select(*KEYS, "known", "kth", "error", F.explode("items").alias("x"))
    # A value whose true count may reach that of the k-th is a candidate; either counter may be off.
    items = items.where((F.col("known") == "all") | (F.col("x.count") >= F.col("kth") - 2 * F.col("error")))
    return judged.select(*KEYS, "n", "error", "known"), items.select(*KEYS, F.col("x.item").alias("value"), F.col("x.count").alias("estimate"))


def top_categories(tables: dict[str, DataFrame], k: int = 10, tracked: int = TRACKED) -> DataFrame | None:
    """Top k values (count desc, value asc) of every text column per table, with exact counts.

    Counters of bounded size name the candidates, and only these are counted
    again and shuffled. Columns whose counters are exact need no second look;
    those whose values are too much alike to be told apart by counters (and
    those with fewer than k candidates) are counted in full.
    """
    named = {t: df for t, df in tables.items() if text_columns(df)}
    if not named:
        return None
    columns, items = heavy_hitters(named, k, tracked)
    known = {(r.table_name, r.column_name): r.known for r in columns.collect()}  # one row a column
    exact = items.join(F.broadcast(columns.where("known = 'all'").select(*KEYS)), KEYS).select(*KEYS, "value", F.col("estimate").alias("count"))
    parts = [exact]
    again = {t: [c for c in text_columns(df) if known[t, c] != "all"] for t, df in named.items()}
    values = [df.unpivot([], again[t], "column_name", "value").where(F.col("value").isNotNull()).withColumn("table_name", F.lit(t))
              for t, df in named.items() if again[t]]
    if values:
        # Every value of a column without candidates, and the candidates of the others: at most ``tracked`` a column.
        wanted = items.select(*KEYS, "value", F.lit(True).alias("_wanted"))
        full = [F.struct(F.lit(t), F.lit(c)) for t, cs in again.items() for c in cs if known[t, c] == "none"]
        rows = _union(values)
        if any(x == "top" for x in known.values()):
            rows = rows.join(F.broadcast(wanted), [*KEYS, "value"], "left")
            keep = F.col("_wanted").isNotNull()
            rows = rows.where(keep | F.struct("table_name", "column_name").isin(*full) if full else keep)
        parts.append(rows.groupBy(*KEYS, "value").agg(F.count(F.lit(1)).alias("count")))
    w = Window.partitionBy(*KEYS).orderBy(F.col("count").desc(), F.col("value").asc())
    return _union(parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def table_size_comparison(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table (file bytes come from ``sources.feeds.feed_inventory``)."""
    return _union([df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(t).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        for t, df in tables.items()])


def missing_matrix(tables: dict[str, DataFrame]) -> DataFrame:
    """table x column percent missing (only columns with any missing)."""
    return missing_values(tables).groupBy("table_name").pivot("column_name").agg(F.first("missing_pct"))


def quality_issue_matrix(tables: dict[str, DataFrame]) -> DataFrame:
    """table x issue sum of counts."""
    q = quality_issues(tables)
    return q.groupBy("table_name").pivot("issue", ["negative_values", "zero_values", "outliers"]).agg(
        F.sum("count"))


def profile_city(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Everything above for one feed, as named result tables."""
    return {
        "profile": profile_tables(tables),
        "schema": table_schema(tables),
        "numeric_stats": numeric_stats(tables),
        "missing_values": missing_values(tables),
        "quality_issues": quality_issues(tables),
        "top_categories": top_categories(tables),
    }


def profile_typed(df: DataFrame) -> DataFrame:
    """Type text columns for profiling the way a CSV profiler reads them.

    A column is numeric (double) when every non-null value parses as a
    number; an all-null column counts as numeric. One aggregate pass decides
    for all columns at once.
    """
    text = text_columns(df)
    if not text:
        return df
    checks = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c)
                      for c in text]).first()
    numeric = {c for c in text if checks[c] == 0}
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in df.columns])
