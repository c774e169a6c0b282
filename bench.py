"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion through the ``noop`` sink (every row
computed, nothing collected).  A first pass over all queries warms the JVM
(class loading, code generation); its times are reported as ``cold``.  The
second pass is the measurement (``queries`` and ``value``).  Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from telewatch.plans.registry import entries  # noqa: E402
from telewatch.session import build_session, drop_scratch  # noqa: E402

HEADLINE = [
    "q8_report_by_system",      # flagship: date range + per-system report
    "r_risk_classes",           # row classification, all rules
    "q1_latest_metric",         # latest row per system
    "q4_history_last100",       # last-N per system
    "q7_pagination",            # skew-safe positions
    "c1_counter_rates",         # counters -> rates (two ordered scans)
    "c5_top_processes",         # top process per snapshot
    "c11_smart_report_fields",  # regex extraction
    "b_calibration",            # covariance + inverse per system
    "t1_moderate_cooldown",     # cooldown fold
    "t2_sustained_high",        # streaks
    "t7_alert_table",           # alert table with resolution times
    "d6_balanced_classes",      # exact seeded balancing
    "m4_standard_scaling",      # split + scaling
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="telewatch-bench",
                          shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    reg = entries()

    def run(name: str) -> float:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = round(time.perf_counter() - t0, 3)
        drop_scratch(spark)
        return took

    cold = {name: run(name) for name in names}
    times = {name: run(name) for name in names}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf,
                      "cold": {"total": round(sum(cold.values()), 3), "queries": cold}}))


if __name__ == "__main__":
    main()
