"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from tessera.plans.queries import queries

HEADLINE = (
    "content_profile", "html_waste", "repeated_lines", "request_summary", "savings_windows", "counter_rollup_day", "dashboard_day", "ab_savings_ci", "savings_cube", "field_stats", "zscore_outliers",
    "change_points", "context_lines", "sessions_by_gap", "read_lifecycle", "loop_detection", "top_n_plan", "smart_sample_plan", "bm25_top", "cosine_top", "scd2_as_of", "graph_hops", "budget_greedy", "token_f1", "compress_payloads", "stream_tumbling",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    found, took = queries(), {}
    for name in HEADLINE:
        began = time.time()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else folder}))


if __name__ == "__main__":
    main()
