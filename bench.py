"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of local cores.
Each query runs once to warm up and then three times; the median counts. The
result is computed in full and thrown away (Spark's noop sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.registry.queries import QUERIES  # noqa: E402
from corpusloom.sources.staging import purge  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "bucket_counts",
    "collapse_sql",
    "norm_sql",
    "feature_rollup",
    "build_records",
    "completion_span",
    "cleaning_report",
    "dedupe_first",
    "dedupe_documents",
    "quota_fill",
    "quota_topup",
    "stratified_split",
    "split_documents",
    "merged_order",
    "length_profile",
    "profile_corpus",
    "score_by_stratum",
    "jsonl_round_trip",
    "build_subset",
    "merge_and_split",
)
RUNS = 3


def seconds(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds(spark, name)
        times[name] = round(statistics.median(seconds(spark, name) for _ in range(RUNS)), 3)
    purge(spark)
    print(json.dumps({
        "metric": "headline queries, sum of medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
