"""Time the headline queries and print one JSON line.

Three queries run untimed first, so that the times show the queries and not
the start of the virtual machine.

BENCH_SF_DIR names the folder with the tables, BENCH_CPUS the local cores.
Every query runs to its last row (written to a sink that drops the rows).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "c1_column_profile",
    "c1_free_text_profile",
    "c2_readiness_scores",
    "c3_column_risks",
    "c4_drift_table",
    "c5_governance_scores",
    "c6_check_scores",
    "c7_schema_drift_score",
    "c8_filled_table",
    "c9_outlier_score",
    "c10_fixed_types",
    "a5_numeric_stats",
    "a7_value_counts",
    "a11_duplicate_rows",
    "f8_pii_search",
    "f16_rows_without_outliers",
    "j6_rows_of_duplicate_groups",
    "j7_knn_fill",
    "l1_top_values",
    "m2_resolved_entities",
    "m3_deduplicated",
    "m4_compliance_tags",
    "t1_ks_statistic",
    "t3_psi",
    "w2_forward_fill",
    "w6_row_ids",
]

WARM_UP = ["c1_column_profile", "c2_readiness_scores", "c4_drift_table"]


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    spark.sparkContext.setLogLevel("OFF")
    from plumbline.plans.catalogue import QUERIES

    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    for name in WARM_UP:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
