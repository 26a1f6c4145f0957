"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tidemill.queries import QUERIES  # noqa: E402
from tidemill.session import local_session  # noqa: E402

HEADLINE = [
    "column_profile_lineitem", "dataset_overview", "column_statistics_numeric", "value_counts", "data_quality_report",
    "duplicate_count", "missing_values", "correlation_pearson", "correlation_spearman", "correlation_kendall", "histogram",
    "box_plot_by_group", "scatter_grid", "fill_median", "fill_mode", "forward_fill", "remove_duplicates_first",
    "detect_outliers_iqr", "remove_outliers_zscore", "standard_scaler", "robust_scaler", "one_hot_encode", "label_encode",
    "label_encode_many", "polynomial_features", "pca_transform", "split_statistics_class", "classification_metrics", "roc_auc",
    "regression_metrics", "score_linear_model", "train_model", "step_run_table", "hourly_stats", "users_with_counts",
    "last_rows_per_parent", "kpi_row", "fuzzy_search", "redact_json", "stream_ingest", "stream_hourly",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"))
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that session start is not charged to the first entry.
    QUERIES["count_recent"](spark, folder).collect()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
