"""Time the analyses over stored metadata tables; prints one JSON line.

The metadata tables are derived from ``$BENCH_SF_DIR`` and written to parquet once, as a collector
would leave them, to ``$BENCH_STORE`` or else to a temporary folder. Each query then runs from the files: once to warm up and ``$BENCH_RUNS`` times
for the median. The value is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import CHECKS  # noqa: E402
from checks.inputs import Inputs, store  # noqa: E402
from slotledger.session import build_session  # noqa: E402

QUERIES = [
    "storage_forecast", "physical_datasets", "org_storage_status", "storage_recommendations", "storage_kpis",
    "job_costs", "job_costs_of_a_past_day", "project_cost_summary", "top_jobs",
    "slot_recommendations", "merged_slot_recommendation", "all_slot_recommendations", "current_reservations",
    "slot_utilization", "slot_utilization_by_hour", "slot_utilization_by_day",
    "baseline_cost_matrix", "best_baseline_per_plan",
    "provisioning_timeline", "provisioned_slot_hours", "utilization_vs_provisioned", "peak_slots",
    "trickle_hours", "trickle_summary", "trickle_heatmap", "trickle_top_queries",
    "top_spenders", "cost_attribution_proportional", "cost_attribution_central",
]


def timed(df) -> float:
    begun = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    # on a cluster, BENCH_STORE names a folder that all executors share
    with tempfile.TemporaryDirectory(prefix="bench-") as local:
        root = os.environ.get("BENCH_STORE", local)
        begun = time.perf_counter()
        stored = store(Inputs(spark, sf_dir), root)
        setup = time.perf_counter() - begun
        for name in QUERIES:
            build, _ = CHECKS[name]
            timed(build(stored))
            seconds[name] = round(statistics.median(timed(build(stored)) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "sum of warm medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": int(cpus), "runs": runs,
        "setup_sec": round(setup, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
