"""Text and summary reports built as DataFrames of lines.

Lines carry ordering keys and are formatted with Spark's string functions;
``write_lines`` sorts them and writes one text file per report. Reports
are bounded by schema width or a top-k list, never by data size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.operators.common import city_keys
from mobilis.operators.topk import busiest_routes


def profile_report(city: str, profile: DataFrame, missing: DataFrame, issues: DataFrame | None,
                   sizes: DataFrame | None = None) -> DataFrame:
    """Per table: records, columns, size, duplicates, missing values and quality issues.

    ``profile`` is ``profile_tables`` output, ``missing`` is ``missing_values``,
    ``issues`` is ``quality_issues``, ``sizes`` optional (table_name, size_mb).
    Returns (t, section, n, line) rows; order by them.
    """
    spark = profile.sparkSession
    t = F.col("table_name")
    p = profile if sizes is None else profile.join(sizes, "table_name", "left")
    size = (F.format_string("Memory: %.2f MB", F.coalesce(F.col("size_mb"), F.lit(0.0)))
            if sizes is not None else F.lit(None).cast("string"))
    head = p.select(t, F.explode(F.array(
        F.struct(F.lit(0).alias("n"), F.concat(F.upper(t), F.lit(" ANALYSIS")).alias("line")),
        F.struct(F.lit(1).alias("n"), F.concat(F.lit("Records: "), F.format_number("n_rows", 0)).alias("line")),
        F.struct(F.lit(2).alias("n"), F.concat(F.lit("Columns: "), F.col("n_columns").cast("string")).alias("line")),
        F.struct(F.lit(3).alias("n"), size.alias("line")),
        F.struct(F.lit(4).alias("n"), F.concat(F.lit("Duplicates: "), F.col("duplicates").cast("string")).alias("line")),
    )).alias("x")).select(t, F.lit(0).alias("section"), "x.n", "x.line").where(F.col("line").isNotNull())

    miss = missing.select(t, F.lit(1).alias("section"), F.col("column_name").alias("_c"),
                          F.format_string("  %s: %s (%.1f%%)", "column_name", F.format_number("missing", 0),
                                          "missing_pct").alias("line"))
    parts = [head, miss.select(t, "section", F.lit(0).alias("n"), "line")]
    if issues is not None:
        order = F.when(F.col("issue") == "negative_values", 0).when(F.col("issue") == "zero_values", 1).otherwise(2)
        iss = issues.select(t, F.lit(3).alias("section"), order.alias("n"),
                            F.format_string("  %s_%s: %s", "issue", "column_name",
                                            F.format_number("count", 0)).alias("line"))
        parts.append(iss)
    tables = profile.select(t)
    flags = [
        tables.select(t, F.lit(1).alias("section"), F.lit(-1).alias("n"), F.lit(" MISSING VALUES:").alias("line"))
              .join(missing.select(t).distinct(), "table_name", "left_semi"),
        tables.select(t, F.lit(1).alias("section"), F.lit(-1).alias("n"), F.lit(" No missing values").alias("line"))
              .join(missing.select(t).distinct(), "table_name", "left_anti"),
    ]
    if issues is not None:
        flags += [
            tables.select(t, F.lit(3).alias("section"), F.lit(-1).alias("n"),
                          F.lit(" DATA QUALITY ISSUES:").alias("line"))
                  .join(issues.select(t).distinct(), "table_name", "left_semi"),
            tables.select(t, F.lit(3).alias("section"), F.lit(-1).alias("n"),
                          F.lit(" No data quality issues").alias("line"))
                  .join(issues.select(t).distinct(), "table_name", "left_anti"),
        ]
    body = reduce(lambda a, b: a.unionByName(b), parts + flags)
    title = spark.createDataFrame([("", -1, 0, f"EDA Report - {city.upper()}"), ("", -1, 1, "=" * 50)],
                                  "table_name string, section int, n int, line string")
    return title.unionByName(body)


def route_mapping_report(route_stats: DataFrame, k: int = 20, names: str = "fallback") -> DataFrame:
    """Lines for the busiest k routes: id, name, trips, separator (per city)."""
    keys = city_keys(route_stats)
    top = busiest_routes(route_stats, k, names)
    lines = top.select(*keys, "rank", F.explode(F.array(
        F.struct(F.lit(0).alias("n"), F.concat(F.lit("Route ID: "), F.col("route_id").cast("string")).alias("line")),
        F.struct(F.lit(1).alias("n"), F.concat(F.lit("Route Name: "), F.col("route_name")).alias("line")),
        F.struct(F.lit(2).alias("n"), F.concat(F.lit("Number of Trips: "), F.col("num_trips").cast("string"))
                 .alias("line")),
        F.struct(F.lit(3).alias("n"), F.lit("-" * 30).alias("line")),
    )).alias("x")).select(*keys, "rank", "x.n", "x.line")
    return lines


def executive_summary(assessment: DataFrame) -> DataFrame:
    """One row: cities, findings (strengths), recommendations (improvements), total routes."""
    return assessment.agg(
        F.sort_array(F.collect_list("city")).alias("cities"),
        F.flatten(F.collect_list(F.transform("key_strengths", lambda s: F.concat_ws(": ", F.lit("strength"), s))))
         .alias("key_findings"),
        F.array_distinct(F.flatten(F.collect_list("improvement_areas"))).alias("recommendations"),
        F.sum(F.coalesce("total_routes", F.lit(0))).alias("total_routes"),
        F.count(F.lit(1)).alias("cities_analyzed"),
    ).withColumn("recommendations_provided", F.size("recommendations"))


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write report lines, in order, as one text file (reports are small by construction)."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """A small result as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)
