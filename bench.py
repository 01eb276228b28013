"""Time the headline queries; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortry.plans.catalog import all_queries  # noqa: E402

HEADLINES = (
    "missingness_by_column", "duplicate_rows", "identifier_summary", "categorical_summary",
    "numeric_summary", "validation_report", "data_dictionary", "split_by_entity_hash",
    "split_by_entity_exact", "split_manifest", "recurrency", "engineered_features",
    "feature_stats", "psi_events", "drift_by_feature", "monitoring_summary", "roc_auc_lines",
    "pr_curve_lines", "calibration_curve", "binary_metrics", "multiclass_metrics",
    "resample_under", "resample_over", "mean_abs_contributions", "explained_rows",
    "prediction_log", "logistic_scores", "feature_split_store", "psi_by_value",
    "resample_under_repeated_keys", "resample_over_null_keys",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    # Start the JVM and the code generator before the clock.
    known["calibration_curve"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
