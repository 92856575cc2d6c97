"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver), twice: the cold run pays code generation
and JIT warm-up, the warm run is the steady state. Prints one JSON line with
the warm total as ``value`` and the cold figures alongside.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera import session  # noqa: E402
from tessera.plans import registry  # noqa: E402

HEADLINE = [
    "rollup_1h", "rollup_1d", "summary_cascade", "timeseries_short", "timeseries_long", "bucket_agg_policy",
    "counter_rate", "running_avg_rate", "per_request_rate", "trend", "hist_percentile", "goodput", "slo_join",
    "fleet_aggregate", "provider_groups", "pid_tree", "gpu_placement", "scrape_ingest", "warmup_baseline",
    "failure_streak", "log_lines", "launch_extract", "latest_state_join", "network_totals", "memory_split",
    "power_scale", "unpivot_series", "node_roster", "baseline_subtract", "pricing_lookup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = session.build(f"local[{cpus}]", "tessera-bench", {
        "spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2)),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
    })
    registry.load_all()
    names = [q for q in (only or HEADLINE) if q in registry.QUERIES]
    # JVM / reader warm-up outside the timed section
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    cold, warm = {}, {}
    for name in names:
        for store in (cold, warm):  # first run pays code generation / JIT; second is the steady state
            t0 = time.perf_counter()
            registry.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            store[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec_warm", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold_total_sec": round(sum(cold.values()), 3), "cold_queries": cold,
                      "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
