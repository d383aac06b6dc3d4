"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS the
timed runs per query after one warm-up (the median counts).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from foldlight.plans.catalog import QUERIES  # noqa: E402
from foldlight.session import local_session  # noqa: E402

HEADLINE = [
    "s1_read_class_features",
    "s7_read_ratings",
    "f1_k_fold",
    "f5_stratified_sample_exact",
    "j1_relevant_documents",
    "j2_rates_and_predictions",
    "j3_holdout_rest",
    "a1_items_by_user",
    "p6_with_row_id",
    "e1_confusion_matrix",
    "e5_macro_metrics",
    "e6_threshold_curves",
    "e9_areas",
    "e13_multilabel_micro",
    "e14_ranking_metrics",
    "e15_regression_metrics",
    "n5_threshold_search",
    "q1_column_stats",
    "q2_correlation_spearman",
    "q5_chi_square_independence",
    "q7_kolmogorov_smirnov",
    "q8_kernel_density",
    "q9_welch_test",
    "t2_index_features",
    "t9_singular_values",
    "g1_frequent_itemsets",
    "g4_frequent_sequences",
    "c3_within_cluster_cost",
    "m5_fit_naive_bayes",
    "m6_best_split_of_tree",
    "r1_fit_linear_regression",
    "r5_fit_isotonic",
    "n1_cross_validate_naive_bayes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    seconds = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
