"""Registered queries on files: feeds written as text and read back, the store, ordered results.

Each writes whole views of the given tables under the shared checkpoint
folder, works on the files like a user's job, and returns what is in them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis import constants as K
from mobilis.plans import jobs as J
from mobilis.plans.common import rounded
from mobilis.plans.queries import metrics_of, register
from mobilis.session import scratch_path
from mobilis.sources import bindings as B
from mobilis.sources import feeds as FD
from mobilis.sources import tables as ST

#: Columns of each written feed table.
FEED_COLUMNS = {
    "routes": ["route_id", "route_short_name", "route_long_name"],
    "trips": ["route_id", "service_id", "trip_id"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "stop_times": ["trip_id", "arrival_time", "stop_id", "stop_sequence"],
}


def feed_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The views of a whole feed, with city: agencies are nations, calendars the services of the trips."""
    tables = {t: B.view(spark, sf, t).select("city", *cols) for t, cols in FEED_COLUMNS.items()}
    agency = B.read_table(spark, sf, "nation").selectExpr("n_nationkey AS agency_id", "n_name AS agency_name", "'UTC' AS agency_timezone")
    tables["agency"] = agency.select(F.explode(F.array(*[F.lit(c) for c in B.CITIES])).alias("city"), "*")
    weekdays = [F.lit(1 if d not in ("saturday", "sunday") else 0).alias(d) for d in K.WEEKDAY_COLUMNS]
    tables["calendar"] = tables["trips"].select("city", "service_id").distinct().select("city", "service_id", *weekdays)
    return tables


def write_city(tables: dict[str, DataFrame], base: str, city: str) -> None:
    for t, df in tables.items():
        FD.write_feed(df.where(F.col("city") == city).drop("city"), f"{base}/{city}/{t}.txt")


def _touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at).close()


def _listing(spark: SparkSession, sf: str) -> str:
    """A feed without header lines, in which one city has an empty file and one lacks a file."""
    base = scratch_path(spark, "listing")
    for t in ("routes", "trips", "stop_times", "calendar"):
        df = feed_tables(spark, sf)[t]
        for city in B.CITIES:
            if (city, t) != ("bangalore", "calendar"):
                FD.write_feed(df.where(F.col("city") == city).drop("city"), f"{base}/{city}/{t}.txt", header=False)
    _touch(spark, f"{base}/delhi/stops.txt")
    return base


@register("feed_inventory")
def q_feed_inventory(spark, sf):
    return rounded(FD.feed_inventory(spark, _listing(spark, sf)))


@register("feed_completeness")
def q_feed_completeness(spark, sf):
    return FD.feed_completeness(spark, _listing(spark, sf), [*B.CITIES, "pune"])


@register("read_feed")
def q_read_feed(spark, sf):
    """Routes with quotes, commas and letters outside ASCII, in two encodings, each read once."""
    base = scratch_path(spark, "feed-texts")
    routes = B.view(spark, sf, "routes")
    out = []
    for encoding, mark in (("ISO-8859-1", "Süd"), ("UTF-8", "Süd → 北")):
        name = F.concat(F.lit('Linie "'), F.col("route_long_name"), F.lit(f'", {mark}'))
        path = f"{base}/{encoding}/routes.txt"
        FD.write_feed(routes.withColumn("route_long_name", name).select("city", *FEED_COLUMNS["routes"]), path, encoding)
        feed = FD.store_feed(spark, path, "routes")
        out.append(feed.df.select(F.lit(feed.encoding).alias("encoding"), F.lit(feed.rows).cast("long").alias("n_rows"), "city",
                                  *FEED_COLUMNS["routes"]))
    return out[0].unionByName(out[1])


@register("read_feed_large")
def q_read_feed_large(spark, sf):
    """Stop times of which some sequence numbers are words: the column stays text; whole numbers elsewhere."""
    path = f"{scratch_path(spark, 'feed-large')}/stop_times.txt"
    rows = B.view(spark, sf, "stop_times")
    sequence = F.when(F.col("stop_sequence") == 7, F.lit("seven")).otherwise(F.col("stop_sequence").cast("string"))
    rows = rows.withColumn("stop_sequence", sequence).withColumn("departure_time", F.lit("08:00:00"))
    FD.write_feed(rows.select("city", *FEED_COLUMNS["stop_times"]), path)
    df, large = FD.read_feed_large(spark, path, "stop_times", threshold=10_000)
    return df.select("city", *FEED_COLUMNS["stop_times"], F.lit(large).alias("is_large"))


def _loaded(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """A store with two cities, of which one lacks stops, then one loaded again with a quarter of its trips; and the load reports."""
    base, store = scratch_path(spark, "feeds"), scratch_path(spark, "store")
    tables = feed_tables(spark, sf)
    write_city(tables, base, "delhi")
    write_city({**tables, "stops": tables["stops"].where(F.lit(False))}, base, "bangalore")
    reports = [(1, c, ST.import_city(spark, base, c, store)) for c in ("delhi", "bangalore")]
    FD.write_feed(tables["trips"].where("city = 'delhi' and trip_id % 8 = 0").drop("city"), f"{base}/delhi/trips.txt")
    reports.append((2, "delhi", ST.import_city(spark, base, "delhi", store)))
    every = [df.select(F.lit(step).alias("load"), F.lit(city).alias("city"), "*") for step, city, df in reports]
    return store, reduce(DataFrame.unionByName, every)


@register("import_city")
def q_import_city(spark, sf):
    return _loaded(spark, sf)[1]


@register("essential_gate")
def q_essential_gate(spark, sf):
    """Verdict per city, beside the trips that the store holds after the second load."""
    store, _ = _loaded(spark, sf)
    verdicts = [(c, ST.essential_gate(spark, store, c)) for c in B.CITIES]
    trips = ST.read_table(spark, store, "trips").groupBy("city").agg(F.count(F.lit(1)).alias("trips"))
    return trips.join(spark.createDataFrame(verdicts, "city string, passed boolean"), "city")


@register("write_table")
def q_write_table(spark, sf):
    """Trips of two cities, then one city's written again without some: its partition is replaced, the other stays."""
    path = scratch_path(spark, "trips")
    trips = B.view(spark, sf, "trips")
    ST.write_table(trips, path)
    ST.write_table(trips.where("city = 'bangalore' and trip_id % 3 > 0"), path)
    return spark.read.parquet(path).select("city", "trip_id", "route_id", "service_id")


@register("ordered_outputs")
def q_ordered_outputs(spark, sf):
    """Route statistics as the sink writes them, with each row's place over all files in order of their numbers."""
    out = scratch_path(spark, "ordered")
    J.write_ordered({"route_stats": metrics_of(spark, sf, "route_stats")["route_stats"]}, out)
    return ST.written_order(spark, f"{out}/route_stats").select("place", "city", "route_id", "num_trips")
