"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from mobilis.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")]
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for k in keys or list(qs):
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf)
            srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SPARK ERROR {str(e)[:300]}")
            bad.append(k)
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"{k:32s} rows={len(srows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.sql(sqls[k])
            dcols = rel.columns
            drows = [tuple(norm(x) for x in r) for r in rel.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} DUCKDB ERROR {str(e)[:300]}")
            bad.append(k)
            continue
        status = "OK"
        if sorted(scols) != sorted(dcols):
            status = f"COLS spark={scols} duck={dcols}"
        else:
            order = [dcols.index(c) for c in scols]
            drows = [tuple(r[i] for i in order) for r in drows]
            key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
            s_sorted, d_sorted = sorted(srows, key=key), sorted(drows, key=key)
            if len(srows) != len(drows):
                status = f"ROWS spark={len(srows)} duck={len(drows)}"
            elif s_sorted != d_sorted:
                diff = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b][:3]
                status = f"VALUES {diff}"
        if status != "OK":
            bad.append(k)
        print(f"{k:32s} rows={len(srows):7d} {ts:5.1f}s {status[:600]}")
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
