"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores. Every query runs to the end into a
no-op sink, once untimed on the smallest tables beforehand so that code is compiled.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from martloom.session import get_session

HEADLINE = (
    "feature_mart", "chain_step1", "preprocess_job", "aggregate_by_key", "column_profiles", "narrow_types_report",
    "contract_violations", "multi_file_scan", "union_widening", "one_hot", "label_codes_encode", "date_features",
    "scale_standard", "drop_correlated", "corr_pairs_wide", "group_split_exact", "ratio_split_stratified",
    "folds_stratified", "macro_metrics", "auc_gini", "auc_many_ties", "gini_stability_score", "regression_scores",
    "ensemble_grid", "ensemble_draws", "run_reports", "cv_regressor", "batch_scoring",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "6g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    from martloom.catalog import QUERIES

    def run(name: str, path: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times = {}
    for name in names:
        if os.path.isdir(warm):
            run(name, warm)
        times[name] = round(run(name, sf_dir), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
