"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Times are wall clock for producing every row (a no-op sink): the median of $BENCH_RUNS runs (3 by
default). Tables that several queries share are built by each query, inside its own time. The seconds
until a query's plan stands, tables it stores on the way included, are given apart as `planning`.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cyclelake.plans import registry
from cyclelake.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "j1_order_link",
    "j2_shift_link",
    "j4_overlapping_orders",
    "a1_hourly_rollup",
    "a2_timeline_order",
    "a6_quality_summary",
    "a12_fleet_status",
    "a14_status_as_of_one_instant",
    "j15_planned_vs_measured",
    "s10_recent_cycles",
    "w1_volatility_lineitem",
    "w4_future_instability",
    "w6_scrap_bursts_lineitem",
    "w11_gap_sessions",
    "w12_downtime_segments",
    "j9_incident_context",
    "j11_comparable_baseline",
    "d12_investigation_result",
    "a20_stability_index",
    "a21_ks_statistic",
    "a24_calibration",
    "a26_classifier_metrics",
    "k1_rows_to_append",
    "k4_upserted_orders",
    "v5_invalid_values",
    "m4_mapped_rows",
    "x5_hourly_stream",
]


def main() -> None:
    spark = local_session(cores=CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    builders = registry.queries()
    builders["j7_site_clock"](spark, FOLDER).write.format("noop").mode("overwrite").save()
    times, planning = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            built = builders[name](spark, FOLDER)
            planned = time.perf_counter()
            built.write.format("noop").mode("overwrite").save()
            runs.append((time.perf_counter() - started, planned - started))
        times[name], planning[name] = (round(statistics.median(x), 3) for x in zip(*runs))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "planning": planning,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
