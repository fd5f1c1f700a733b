"""DuckDB SQL of the queries on files."""

from __future__ import annotations

from collections.abc import Callable

#: Bytes of a written line: its cells, the commas between them and the line end.
_LINES = {
    "routes": ["route_id", "route_short_name", "route_long_name"],
    "trips": ["route_id", "service_id", "trip_id"],
    "stop_times": ["trip_id", "arrival_time", "stop_id", "stop_sequence"],
}
_CALENDAR = "(SELECT DISTINCT city, service_id FROM trips)"


def _sizes() -> str:
    parts = []
    for t, cols in _LINES.items():
        cells = " + ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))), 0)" for c in cols)
        parts.append(f"SELECT city, '{t}.txt' AS file_name, CAST(sum({cells} + {len(cols)}) AS BIGINT) AS size_bytes FROM {t} GROUP BY city")
    parts.append(f"SELECT city, 'calendar.txt', CAST(sum(octet_length(encode(service_id)) + 15) AS BIGINT) FROM {_CALENDAR} "
                 "WHERE city = 'delhi' GROUP BY city")
    parts.append("SELECT 'delhi', 'stops.txt', 0")
    return " UNION ALL ".join(parts)


def statements(q: Callable[[str], str], digits: int, cities: list[str]) -> dict[str, str]:
    sql = {}
    sizes = _sizes()
    sql["feed_inventory"] = q(f"SELECT *, round(size_bytes / 1048576.0e0, 2) AS size_mb FROM ({sizes})")
    asked = ", ".join(f"('{c}', '{f}')" for c in [*cities, "pune"] for f in
                      ("agency.txt", "calendar.txt", "routes.txt", "stop_times.txt", "stops.txt", "trips.txt"))
    sql["feed_completeness"] = q(
        "SELECT a.city, a.file_name, CASE WHEN size_bytes IS NULL THEN 'missing' WHEN size_bytes = 0 THEN 'empty' ELSE 'present' END AS status, "
        f"size_bytes FROM (VALUES {asked}) a(city, file_name) LEFT JOIN ({sizes}) s ON s.city = a.city AND s.file_name = a.file_name")
    each = " UNION ALL ".join(
        f"SELECT '{encoding}' AS encoding, (SELECT count(*) FROM routes) AS n_rows, city, CAST(route_id AS VARCHAR) AS route_id, "
        f"route_short_name, 'Linie \"' || route_long_name || '\", {mark}' AS route_long_name FROM routes"
        for encoding, mark in (("ISO-8859-1", "Süd"), ("UTF-8", "Süd → 北")))
    sql["read_feed"] = q(each)
    sql["read_feed_large"] = q(
        "SELECT city, CAST(trip_id AS VARCHAR) AS trip_id, nullif(arrival_time, 'n/a') AS arrival_time, CAST(stop_id AS VARCHAR) AS stop_id, "
        "CASE WHEN stop_sequence = 7 THEN 'seven' ELSE CAST(stop_sequence AS VARCHAR) END AS stop_sequence, "
        "(SELECT count(*) > 10000 FROM stop_times) AS is_large FROM stop_times")
    rows = {"agency": f"(SELECT c.city FROM nation, (VALUES {', '.join(f'({c!r})' for c in cities)}) c(city))", "calendar": _CALENDAR,
            "routes": "routes", "trips": "trips", "stops": "stops", "stop_times": "stop_times"}
    counts = " UNION ALL ".join(f"SELECT city, '{t}' AS table_name, count(*) AS n FROM {source} GROUP BY city" for t, source in rows.items())
    sql["import_city"] = q(
        f"SELECT load, city, table_name, CASE WHEN city = 'bangalore' AND table_name = 'stops' THEN 0 "
        "WHEN load = 2 AND table_name = 'trips' THEN (SELECT count(*) FROM trips WHERE city = 'delhi' AND trip_id % 8 = 0) ELSE n END AS rows, "
        "NOT (city = 'bangalore' AND table_name = 'stops') AS loaded, '' AS text_columns "
        f"FROM ({counts}), (SELECT unnest([1, 2])::INTEGER AS load) WHERE load = 1 OR city = 'delhi'")
    sql["essential_gate"] = q(
        "SELECT city, count(*) AS trips, city = 'delhi' AS passed FROM trips WHERE city <> 'delhi' OR trip_id % 8 = 0 GROUP BY city")
    sql["write_table"] = q("SELECT city, trip_id, route_id, service_id FROM trips WHERE city <> 'bangalore' OR trip_id % 3 > 0")
    sql["ordered_outputs"] = q(
        "SELECT row_number() OVER (ORDER BY city, num_trips DESC, route_id) AS place, city, route_id, num_trips FROM route_stats")
    return sql
