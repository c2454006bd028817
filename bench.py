"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the local cores. Each query is run once to
warm up and then timed; every row is computed and dropped.
"""

from __future__ import annotations

import json
import os
import time

from assetlake.session import build_session
from assetlake.workload.registry import queries

HEADLINE = (
    "D1_exact_duplicate_groups", "D2_two_stage_duplicates", "D4_near_duplicate_pairs", "D8_keep_recommendations",
    "D10_duplicate_statistics", "L3_top_duplicate_groups", "J8_backup_comparison", "J10_catalog_reconciliation",
    "J13_drive_of_path", "J20_integrity_outcomes", "J25_transfer_classification", "A11_backup_health",
    "A12_library_summary", "A31_audit_sample", "W8_bursts", "W12_last_n_per_key", "O1_rename_plan", "O2_template_plan",
    "O7_reconciliation_matrix", "O8_backup_priorities", "O12_audit_report_totals", "O14_run_verdict", "Q3_stale_tasks",
    "R3_thermal_event_batch",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    known, times = queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            t0 = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
