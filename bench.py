"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "iqr_flags",
    "group_iqr_summary",
    "numeric_summary",
    "cleaned_table",
    "statistics_by_category",
    "density_curve",
    "contingency_table",
    "univariate_score",
    "full_detection",
    "mahalanobis",
    "rosner_flags",
    "anderson_darling",
    "local_outlier_factor",
    "isolation_forest",
    "dbscan",
    "group_descriptives",
    "mann_whitney",
    "chi_square_tests",
    "correlation_matrix",
    "compare_group_correlations",
    "trend_line",
    "least_squares",
    "component_scores",
    "kmeans_clusters",
    "kaplan_meier",
    "log_rank",
    "roc_curve",
    "feature_ranking",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from checks import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fenceline-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executor threads
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
