"""Views of the driver's test tables as transit feeds and ride records.

The test data is a TPC-H-like star schema plus an ``events`` table; it holds
no feed or ride table. Each view below is a pure projection (plus a two-way
city fan-out for the small dimension tables) of a given table, written once
as SQL expressions and rendered for both Spark and DuckDB, so the Spark
queries and the DuckDB oracle see exactly the same rows.

- stop_times <- lineitem, trips <- orders, routes <- customer, stops <-
  supplier, rides <- events; every view covers its whole table.
- route ids are customer keys mod 150 (trips use the order's customer the
  same way), so a route id repeats across customers and the cleaning step's
  one-row-per-key rule picks its names.
- accounts <- customer takes part in the profile only: its balances can be negative.
- ``city`` comes from the order key parity (stop events), or from the user id
  parity (rides); routes and stops exist in both cities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITIES = ["delhi", "bangalore"]

# Dialect pieces that differ between Spark SQL and DuckDB.
_DIALECT = {
    "spark": {
        "idiv": "div",
        "k": "cast(get_json_object(props, '$.k') as int)",
    },
    "duckdb": {
        "idiv": "//",
        "k": "cast(json_extract_string(props, '$.k') as int)",
    },
}

# Seconds of the service day. One city has no service from 2 to 5: its arrivals then come three hours later.
_DAY_SEC = "((l_partkey * 7919 + l_linenumber * 613 + l_orderkey * 31) % 93600)"
_SEC = f"({_DAY_SEC} + case when l_orderkey % 2 = 1 and {_DAY_SEC} {{idiv}} 3600 between 2 and 4 then 10800 else 0 end)"

# Expressions that several columns of a view use, computed once a row.
_SHARED = {"stop_times": [("_sec", _SEC)]}

# When a column of a view is null, from the table's columns alone. Spark copies a condition on a column down to the
# scan with the column's whole expression in it; for the time text that is more code than the JVM compiles, and all rows
# of the scan are then interpreted. With this, "is not null" needs no time text.
_NULL_WHEN = {("stop_times", "arrival_time"): "l_quantity <=> 49 or (not l_quantity <=> 50 "
                                              "and (l_orderkey is null or l_partkey is null or l_linenumber is null))"}

# Column expressions per view, in output order: (alias, sql).
# Time text: quantity 49 -> null, 50 -> 'n/a' (malformed), 48 -> hour not
# zero-padded, 47 -> minutes shifted past 59 (accepted: not range-checked).
# P2(x) renders x as two zero-padded digits.
_VIEWS = {
    "stop_times": ("lineitem", [
        ("city", "case when l_orderkey % 2 = 0 then 'delhi' else 'bangalore' end"),
        ("trip_id", "l_orderkey"),
        ("stop_id", "l_suppkey"),
        ("stop_sequence", "l_linenumber"),
        ("arrival_time",
         "case when l_quantity = 49 then null "
         "when l_quantity = 50 then 'n/a' "
         "when l_quantity = 48 then concat(cast(SEC {idiv} 3600 as string), ':', P2((SEC % 3600) {idiv} 60), ':', "
         "P2(SEC % 60)) "
         "when l_quantity = 47 and (SEC % 3600) {idiv} 60 < 40 "
         "then concat(P2(SEC {idiv} 3600), ':', P2((SEC % 3600) {idiv} 60 + 60), ':', P2(SEC % 60)) "
         "else concat(P2(SEC {idiv} 3600), ':', P2((SEC % 3600) {idiv} 60), ':', P2(SEC % 60)) end"),
    ]),
    "trips": ("orders", [
        ("city", "case when o_orderkey % 2 = 0 then 'delhi' else 'bangalore' end"),
        ("trip_id", "o_orderkey"),
        ("route_id", "o_custkey % 150"),
        ("service_id", "o_orderpriority"),
    ]),
    "routes": ("customer", [
        ("route_id", "c_custkey % 150"),
        ("route_short_name", "case when c_custkey % 20 = 7 then null else c_mktsegment end"),
        ("route_long_name",
         "case when c_custkey % 10 = 3 then '  ' when c_custkey % 10 = 7 then null else c_name end"),
    ]),
    "stops": ("supplier", [
        ("stop_id", "s_suppkey"),
        ("stop_name", "s_name"),
        ("stop_lat", "case when city = 'delhi' then 28.5e0 else 12.9e0 end + cast(s_suppkey % 40 as double) / 100e0"),
        ("stop_lon", "case when city = 'delhi' then 77.0e0 else 77.5e0 end + cast(s_suppkey % 30 as double) / 100e0"),
    ]),
    "accounts": ("customer", [
        ("account_id", "c_custkey"),
        ("segment", "c_mktsegment"),
        ("balance", "cast(c_acctbal as double)"),
    ]),
    "rides": ("events", [
        ("ride_id", "event_id"),
        ("city", "case when user_id % 2 = 0 then 'delhi' else 'bangalore' end"),
        ("timestamp", "ts + (event_id % 366) * interval '1' day"),
        ("service", "case user_id % 3 when 0 then 'uber' when 1 then 'ola' when 2 then case when event_id % 50 = 7 then 'metro' else 'rapido' end end"),
        ("vehicle_type", "case K % 4 when 0 then 'mini' when 1 then 'prime' when 2 then 'auto' else 'bike' end"),
        ("start_lat", "case when user_id % 2 = 0 then 28.45e0 + cast(event_id % 53 as double) * 0.005e0 "
                      "else 12.90e0 + cast(event_id % 29 as double) * 0.005e0 end"),
        ("start_lon", "case when user_id % 2 = 0 then 77.0e0 + cast(event_id * 7 % 79 as double) * 0.005e0 "
                      "else 77.48e0 + cast(event_id * 7 % 37 as double) * 0.005e0 end"),
        ("end_lat", "case when user_id % 2 = 0 then 28.45e0 + cast(event_id % 53 as double) * 0.005e0 "
                    "else 12.90e0 + cast(event_id % 29 as double) * 0.005e0 end "
                    "+ cast(event_id * 13 % 41 - 20 as double) * 0.004e0"),
        ("end_lon", "case when user_id % 2 = 0 then 77.0e0 + cast(event_id * 7 % 79 as double) * 0.005e0 "
                    "else 77.48e0 + cast(event_id * 7 % 37 as double) * 0.005e0 end "
                    "+ cast(event_id * 17 % 43 - 21 as double) * 0.004e0"),
        ("distance_km", "0.1e0 + cast(event_id * 37 % 1100 as double) / 10e0"),
        ("duration_mins", "1e0 + cast(event_id * 53 % 200 as double)"),
        ("surge_multiplier", "1e0 + cast(K % 20 as double) / 20e0"),
        ("fare", "value * 10e0"),
    ]),
}

# Dimension views that exist once per city.
_PER_CITY = {"routes", "stops"}


def _pad2(expr: str) -> str:
    """Two-digit zero-padded text of an integer expression (same in both dialects)."""
    return f"lpad(cast({expr} as string), 2, '0')"


def _render(expr: str, dialect: str) -> str:
    d = _DIALECT[dialect]
    out = expr.replace("SEC", "_sec").replace("K", d["k"]).replace("{idiv}", d["idiv"])
    while "P2(" in out:  # P2(x) -> lpad(cast(x as string), 2, '0'), balanced parentheses
        i = out.index("P2(") + 3
        depth, j = 1, i
        while depth:
            depth += {"(": 1, ")": -1}.get(out[j], 0)
            j += 1
        out = out[:i - 3] + _pad2(out[i:j - 1]) + out[j:]
    return out


def view_sql(name: str, dialect: str = "duckdb") -> str:
    """SELECT statement of one view over the base table, in a dialect."""
    table, cols = _VIEWS[name]
    shared = "".join(f", {_render(e, dialect)} AS {a}" for a, e in _SHARED.get(name, []))
    table = f"(SELECT *{shared} FROM {table})" if shared else table
    select = ", ".join(f"{_render(e, dialect)} AS {_quote(a, dialect)}" for a, e in cols)
    if name in _PER_CITY:
        cities = ", ".join(f"('{c}')" for c in CITIES)
        return (f"SELECT city, {select} FROM {table} "
                f"CROSS JOIN (VALUES {cities}) AS cities(city)")
    return f"SELECT {select} FROM {table}"


def _quote(alias: str, dialect: str) -> str:
    return f'"{alias}"' if dialect == "duckdb" and alias == "timestamp" else alias


def oracle_with() -> str:
    """A WITH clause defining every view for DuckDB oracle queries."""
    parts = [f"{n} AS ({view_sql(n, 'duckdb')})" for n in _VIEWS]
    return "WITH " + ",\n".join(parts) + "\n"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One binding view as a Spark DataFrame (lazy; column-pruned at the scan)."""
    table, cols = _VIEWS[name]
    base = read_table(spark, sf_dir, table)
    if name in _SHARED:
        base = base.selectExpr("*", *[f"{_render(e, 'spark')} AS {a}" for a, e in _SHARED[name]])
    if name in _PER_CITY:
        # Generated fan-out of a small dimension table, not a join.
        base = base.withColumn("city", F.explode(F.array(*[F.lit(c) for c in CITIES])))
        return base.selectExpr("city", *[f"{_render(e, 'spark')} AS `{a}`" for a, e in cols])
    return base.selectExpr(*[f"{_null_first(_render(e, 'spark'), (name, a))} AS `{a}`" for a, e in cols])


def _null_first(expr: str, column: tuple[str, str]) -> str:
    """A text expression whose nulls are decided by ``_NULL_WHEN`` where that knows the column."""
    return f"case when {_NULL_WHEN[column]} then null else coalesce({expr}, '') end" if column in _NULL_WHEN else expr


def transit_feed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, n) for n in ("stop_times", "trips", "routes", "stops")}


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides")


# Column roles of the views, as the profile sees them (numeric, then text),
# for building the oracle SQL; tests check they agree with the Spark schema.
PROFILE_VIEWS = ["stop_times", "trips", "routes", "stops", "accounts", "rides"]
PROFILE_NUMERIC = {
    "stop_times": ["trip_id", "stop_id", "stop_sequence"],
    "trips": ["trip_id", "route_id"],
    "routes": ["route_id"],
    "stops": ["stop_id", "stop_lat", "stop_lon"],
    "accounts": ["account_id", "balance"],
    "rides": ["ride_id", "start_lat", "start_lon", "end_lat", "end_lon", "distance_km", "duration_mins",
              "surge_multiplier", "fare"],
}
PROFILE_TEXT = {
    "stop_times": ["city", "arrival_time"],
    "trips": ["city", "service_id"],
    "routes": ["city", "route_short_name", "route_long_name"],
    "stops": ["city", "stop_name"],
    "accounts": ["segment"],
    "rides": ["city", "service", "vehicle_type"],
}
PROFILE_WIDTH = {"stop_times": 5, "trips": 4, "routes": 4, "stops": 5, "accounts": 3, "rides": 13}


def profile_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The feed as a city would ship it: every view the metrics read."""
    return {n: view(spark, sf_dir, n) for n in PROFILE_VIEWS}
