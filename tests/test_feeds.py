"""Feed files: golden profile figures, checks, encodings, import into the store."""

import os

from mobilis.operators import profile as PR
from mobilis.operators import transit as T
from mobilis.sources import feeds
from mobilis.sources import tables as ST

from conftest import FIXTURES

FEEDS = os.path.join(FIXTURES, "feeds")


def _profile_inputs(spark, city, names):
    return {n: PR.profile_typed(feeds.read_feed(spark, os.path.join(FEEDS, city, f"{n}.txt"), n, typed=False))
            for n in names}


def test_golden_fare_attributes(spark):
    t = _profile_inputs(spark, "bangalore", ["fare_attributes"])
    p = PR.profile_tables(t).first()
    assert (p.n_rows, p.n_columns, p.duplicates) == (60, 7, 0)
    miss = {(r.column_name, r.missing, round(r.missing_pct, 1)) for r in PR.missing_values(t).collect()}
    assert miss == {("transfers", 60, 100.0)}
    issues = {(r.issue, r.column_name, r["count"]) for r in PR.quality_issues(t).collect()}
    assert issues == {("zero_values", "payment_method", 60), ("zero_values", "transfer_duration", 60),
                      ("outliers", "price", 4)}
    q = {r.column_name: r for r in PR.numeric_stats(t).collect()}
    assert (q["price"].q25, q["price"].q75) == (24.75, 122.5)


def test_golden_small_files(spark):
    t = _profile_inputs(spark, "delhi", ["agency", "calendar"])
    p = {r.table_name: (r.n_rows, r.n_columns, r.duplicates) for r in PR.profile_tables(t).collect()}
    assert p == {"agency": (2, 7, 0), "calendar": (1, 10, 0)}
    miss = {(r.table_name, r.column_name, r.missing) for r in PR.missing_values(t).collect()}
    assert miss == {("agency", "agency_phone", 2), ("agency", "agency_fare_url", 2)}
    assert PR.quality_issues(t).count() == 0
    b = _profile_inputs(spark, "bangalore", ["agency", "calendar", "feed_info"])
    p = {r.table_name: (r.n_rows, r.n_columns) for r in PR.profile_tables(b).collect()}
    assert p == {"agency": (1, 4), "calendar": (1, 10), "feed_info": (1, 8)}
    assert PR.missing_values(b).count() == 0 and PR.quality_issues(b).count() == 0


def test_profile_report_lines(spark):
    from mobilis.operators import report as RP
    t = _profile_inputs(spark, "bangalore", ["fare_attributes"])
    lines = RP.profile_report("bangalore", PR.profile_tables(t), PR.missing_values(t), PR.quality_issues(t))
    text = [r.line for r in lines.orderBy("table_name", "section", "n").collect()]
    assert "FARE_ATTRIBUTES ANALYSIS" in text and "Records: 60" in text
    assert "  transfers: 60 (100.0%)" in text and "  outliers_price: 4" in text


def test_completeness_gate_fails_on_shipped_folders(spark):
    comp = feeds.feed_completeness(spark, FEEDS, ["delhi", "bangalore"])
    missing = {(r.city, r.file_name) for r in comp.where("status = 'missing'").collect()}
    assert ("delhi", "routes.txt") in missing and ("bangalore", "stop_times.txt") in missing
    assert {r.city: r.passed for r in feeds.feed_gate(comp).collect()} == {"delhi": False, "bangalore": False}
    inv = {r.file_name: r.size_bytes for r in feeds.feed_inventory(spark, FEEDS).where("city = 'bangalore'")
           .collect()}
    assert inv["fare_attributes.txt"] == os.path.getsize(os.path.join(FEEDS, "bangalore", "fare_attributes.txt"))


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def _mini_feed(base, city="testcity", stop_name="Central"):
    d = os.path.join(base, city)
    _write(f"{d}/agency.txt", "agency_id,agency_name,agency_url,agency_timezone\nA,Agency,http://x,UTC\n")
    _write(f"{d}/calendar.txt", "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,"
                                "end_date\nS,1,1,1,1,1,0,0,20240101,20241231\n")
    _write(f"{d}/Routes.txt".lower(), "Route ID,route_short_name,route-long-name\nr1,1,One\nr2,2,Two\n")
    _write(f"{d}/trips.txt", "route_id,service_id,trip_id\nr1,S,t1\nr1,S,t2\nr2,S,t3\n")
    _write(f"{d}/stops.txt", f"stop_id,stop_name,stop_lat,stop_lon\np1,{stop_name},12.9,77.5\np2,NA,12.95,77.55\n",
           encoding="latin-1")
    _write(f"{d}/stop_times.txt", "trip_id,arrival_time,stop_id,stop_sequence\nt1,08:00:00,p1,0\nt1,08:10:00,p2,1\n"
                                  "t2,08:30:00,p1,0\nt3,9:00:00,p2,0\nt9,10:00:00,p1,0\n")
    return city


def test_import_city_and_transit_from_store(spark, tmp_dir):
    base, store = os.path.join(tmp_dir, "feeds"), os.path.join(tmp_dir, "store")
    city = _mini_feed(base, stop_name="Café")
    assert feeds.detect_encoding(spark, os.path.join(base, city, "stops.txt")) == "ISO-8859-1"
    res = {r.table_name: (r.rows, r.loaded) for r in ST.import_city(spark, base, city, store).collect()}
    assert res["stop_times"] == (5, True) and res["routes"] == (2, True)
    assert ST.essential_gate(spark, store, city)
    stops = ST.read_table(spark, store, "stops", city)
    names = {r.stop_id: r.stop_name for r in stops.collect()}
    assert names == {"p1": "Café", "p2": None}  # 'NA' text reads as missing
    routes = ST.read_table(spark, store, "routes", city)
    assert {"route_id", "route_short_name", "route_long_name", "city"} <= set(routes.columns)
    feed = {t: ST.read_table(spark, store, t, city) for t in ("stop_times", "trips", "routes", "stops")}
    rs = {r.route_id: r.num_trips for r in T.route_stats(T.build_events(feed)).collect()}
    assert rs == {"r1": 2, "r2": 1}
    # re-import replaces only this city's partition
    ST.import_city(spark, base, city, store)
    assert ST.read_table(spark, store, "trips", city).count() == 3
    assert ST.read_table(spark, store, "nope", city) is None
    # the city filter prunes partitions at the scan
    plan = ST.read_table(spark, store, "stop_times", city)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "testcity" in plan


def test_structure_checks(spark):
    df = spark.createDataFrame([("r1", "x")], "route_id string, route_short_name string")
    assert not feeds.check_structure(df, "routes")
    assert feeds.check_structure(df, "unknown_table")
    assert not feeds.check_structure(df.limit(0), "unknown_table")
    norm = feeds.normalize_columns(spark.createDataFrame([(1,)], "`Stop Name-X` int"))
    assert norm.columns == ["stop_name_x"]
    raw = spark.createDataFrame([("1.5", "x"), ("bad", "y")], "stop_lat string, stop_id string")
    rej = {r.column_name: r.rejects for r in feeds.cast_rejects(raw, __import__("mobilis.schemas").schemas
                                                               .FEED_SCHEMAS["stops"]).collect()}
    assert rej == {"stop_lat": 1, "stop_id": 0}


def test_large_flag_defaults_and_matrices(spark, tmp_dir):
    from mobilis.operators.rides import with_ride_defaults
    path = os.path.join(FEEDS, "bangalore", "fare_attributes.txt")
    _, large = feeds.read_feed_large(spark, path, "fare_attributes", threshold=59)
    _, small = feeds.read_feed_large(spark, path, "fare_attributes", threshold=60)
    assert large and not small
    df = with_ride_defaults(spark.createDataFrame([("r1", 12.0)], "ride_id string, fare double")).first()
    assert (df.fare, df.distance_km, df.duration_mins, df.surge_multiplier) == (12.0, 0.0, 0.0, 1.0)
    t = _profile_inputs(spark, "bangalore", ["fare_attributes"])
    mm = PR.missing_matrix(t).first()
    assert mm.transfers == 100.0
    qm = PR.quality_issue_matrix(t).first()
    assert (qm.zero_values, qm.outliers) == (120, 4)
    missing = feeds.read_feed(spark, os.path.join(tmp_dir, "absent.txt"), "routes")
    assert missing.count() == 0 and "route_id" in missing.columns


def test_quoted_fields_line_ends_and_rejects(spark, tmp_dir):
    path = os.path.join(tmp_dir, "stops.txt")
    with open(path, "w") as f:
        f.write('stop_id,stop_name,stop_lat,stop_lon\n1,"Main ""Old"" St, East",12.0,77.0\n2,"Two\nlines",13.0,78.0\n')
    rows = feeds.read_feed(spark, path, "stops", multi_line=True).orderBy("stop_id").collect()
    assert [(r.stop_name, r.stop_lat, r.stop_lon) for r in rows] == [('Main "Old" St, East', 12.0, 77.0), ("Two\nlines", 13.0, 78.0)]
    assert feeds.read_feed(spark, path, "stops").where("stop_id = 1").first().stop_name == 'Main "Old" St, East'
    raw = spark.createDataFrame([("t", "1.0"), ("t", "7"), ("t", None)], "trip_id string, stop_sequence string")
    typed = feeds.typed_or_string(raw, __import__("mobilis.schemas").schemas.FEED_SCHEMAS["stop_times"])
    assert [r.stop_sequence for r in typed.collect()] == [1, 7, None]
    bad = raw.union(spark.createDataFrame([("t", "x2")], raw.schema))
    kept = feeds.typed_or_string(bad, __import__("mobilis.schemas").schemas.FEED_SCHEMAS["stop_times"])
    assert [r.stop_sequence for r in kept.collect()] == ["1.0", "7", None, "x2"]
