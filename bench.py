"""Headline queries, timed. Two warm-ups, then the median of three runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sigward import plans, session  # noqa: E402, F401
from sigward.plans import registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_UPS, RUNS = 2, 3
HEADLINE = [
    "m4_scan",
    "m1_match_strings",
    "m1_match_strings_items",
    "m6_match_strings_indexed",
    "m6_match_tokens",
    "a2_threat_distribution",
    "c2_threat_report",
    "a5_category_counts",
    "a10_daily_change_counts",
    "j5_asof_detection",
    "w1_dedupe_first",
    "w2_dedupe_rules_by_body",
    "w5_restarts_last_hour",
    "w7_limit_restarts",
    "r1_expire_counts",
    "r2_tier",
    "x9_sha256",
]


def run(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    session.prepare(spark)
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        for _ in range(WARM_UPS):
            run(spark, name)
        times[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    out = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "files": documents,
    }
    if "m4_scan" in times:
        out["files_per_sec"] = round(documents / times["m4_scan"])
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
