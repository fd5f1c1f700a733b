"""Print the physical-plan features of headline queries (used to write PLANS.md).

Usage: python tests/plan_notes.py [sf_dir]
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import queries  # noqa: E402
from mobilis.session import get_session  # noqa: E402

KEYS = ["trip_stop_events", "route_stats", "headways", "busiest_routes", "city_analysis", "peak_vs_offpeak",
        "tariff_fare", "area_surge", "numeric_stats", "trips_histogram", "read_table"]
FEATURES = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
            "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Expand", "Window", "WindowGroupLimit",
            "Exchange", "BatchEvalPython", "ArrowEvalPython"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 8)
    for k in KEYS:
        df = queries()[k](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = {f: len(re.findall(rf"\b{f}\b", plan)) for f in FEATURES}
        scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan)
        scans = sorted(set((re.sub(r"#\d+L?", "", c), p) for c, p in scans))
        print(f"### {k}")
        print("operators: " + ", ".join(f"{f} x{n}" for f, n in counts.items() if n)
              + f"; checkpointed inputs x{plan.count('Scan ExistingRDD')}")
        for cols, pushed in scans:
            print(f"scan columns: {cols} | pushed filters: {pushed or '-'}")
        print()


if __name__ == "__main__":
    main()
