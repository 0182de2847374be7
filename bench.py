"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
BENCH_QUERIES comma-separated names, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegrid.session import build_session  # noqa: E402

HEADLINE = [
    "read_csv_typed", "load_dataset", "read_xy_tail", "write_series_parquet", "write_xy",
    "trim_partial_weeks", "ordered_category_geo",
    "gap_counts", "gap_fill", "gap_fill_inferred", "interpolate_linear", "resample_mean",
    "interpolate_resample", "resample_multi", "shift", "every_nth",
    "xy_windows_flat", "xy_windows_nested", "xy_windows_strided", "xy_windows_dual_flat",
    "xy_windows_dual_nested", "xy_windows_weekly", "xy_windows_dual_weekly",
    "common_ids", "neighbor_ids", "neighbor_features", "join_left_wide",
    "dataset_profile", "pivot_series", "completeness_by_row", "metrics_pivot",
    "standard_scaler_transform", "minmax_scaler_transform", "scale_per_series", "tvt_split",
    "evaluate_metrics", "rank_average", "rank_average_global",
    "friedman_test", "friedman_aligned_ranks_test", "quade_test", "anova_within_test",
    "holm_test", "shaffer_multitest", "wilcoxon", "mannwhitneyu", "wilcoxon_exact", "mannwhitneyu_exact", "infer_calendar_freq",
    "forecast_fit_predict", "forecast_per_series", "forecast_auto", "forecast_arma", "halving_search",
    "run_trials", "run_trials_nonlinear",
    "build_dataset_single_rate", "build_dataset_dual_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidegrid.catalog import QUERIES

    asked = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:32s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
