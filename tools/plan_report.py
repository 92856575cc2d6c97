"""Print the formatted physical plan of registered queries (for plan review between rounds).

    python tools/plan_report.py [--sf DIR] name [name ...]

Reports exchanges, broadcasts, nested-loop joins, pushed filters and read
schemas per query, then the full ``explain("formatted")`` text.
"""

from __future__ import annotations

import argparse
import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera import session  # noqa: E402
from tessera.plans import registry  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--full", action="store_true")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    spark = session.build("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    registry.load_all()
    for n in a.names:
        df = registry.run(n, spark, a.sf)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        summary = {k: len(re.findall(k, text)) for k in
                   ("BroadcastExchange", "BroadcastNestedLoopJoin", "SortMergeJoin",
                    "BroadcastHashJoin", "Window", "WindowGroupLimit", "HashAggregate", "Generate")}
        print(f"===== {n}: " + ", ".join(f"{k}={v}" for k, v in summary.items() if v))
        for line in text.splitlines():
            if line.startswith(("PushedFilters", "ReadSchema", "PartitionFilters")):
                print("   ", line[:200])
        if a.full:
            print(text)
    spark.stop()


if __name__ == "__main__":
    main()
