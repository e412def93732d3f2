"""Headline queries, timed to completion without bringing rows to the driver. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldlens import catalog  # noqa: E402
from fieldlens.session import build_session  # noqa: E402

HEADLINE = (
    "flagship",
    "occurrence_media_join",
    "images_per_taxon",
    "drop_all_duplicates",
    "clean_funnel",
    "group_cap",
    "stratified_split",
    "split_caps",
    "checklist_upsert",
    "stats_reconcile",
    "backbone_match",
    "topk_micro_accuracy",
    "macro_accuracy",
    "accuracy_vs_confidence",
    "expected_calibration_error",
    "taxon_rollup",
    "tune_temperature",
    "batch_score",
    "greedy_box_match",
    "pr_curve",
    "mean_average_precision",
    "frame_assignment",
    "track_ids",
    "hard_example_window",
    "webdataset_sink",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    # the first job of a JVM pays for class loading
    queries["taxon_hierarchy"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cores,
    }))


if __name__ == "__main__":
    main()
