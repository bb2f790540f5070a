"""Time the headline queries: median of three runs after one warm-up, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import bindings  # noqa: E402
from solvane.session import local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "flagship_line_study",
    "p4_keep_valid",
    "p7_known_and_measured",
    "p8_clean_chain",
    "sp1_split_by_size",
    "sp4_stratified_sample",
    "sp6_cleaned_and_stratified",
    "sp7_fold_columns",
    "sp11_shuffled_batches",
    "b2_quantile_bin",
    "a4_metrics_by_phase_and_fold",
    "a6_ensemble",
    "a10_standardise_vectors",
    "a11_correlation_matrix",
    "w1_build_vocabulary",
    "w3_encode_sequences",
    "w5_early_stopping",
    "g2_bfs_order",
    "g3_fragments_radius_1",
    "g3_fragments_radius_2",
    "g5_fragment_sequence",
    "g7_fingerprints",
    "g8_mean_of_neighbours",
    "k4_weighted_kernel",
    "k6_kernel_score",
    "h2_list_parameters",
    "s3_record_scan",
    "st2_trial_progress",
]


def run(spark, name: str) -> float:
    begun = time.perf_counter()
    bindings.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    bindings.load_all()
    spark = local_session(CPUS, "bench")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name)
        times[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    result = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": FOLDER.rsplit("sf", 1)[-1]}
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
