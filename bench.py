"""Headline queries on one machine: prints one JSON line with seconds per query.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) with local[$BENCH_CPUS]. Every query runs once
after a warm-up and writes its whole result to the no-op sink, so nothing is pruned or collected.
"""

from __future__ import annotations

import json
import os
import time

from boxtally.plans.catalogue import QUERIES
from boxtally.session import local_session

HEADLINE = [
    "g3_box_iou", "j1_iou_join", "j2_coco_match", "j3_greedy_match", "j4_iou_assign", "j5_adaptive_assign",
    "j16_pairwise_iou_stats", "d1_nms", "d4_weighted_box_clustering", "d8_ensemble_case", "d9_merge_touching",
    "a1_coco_ap", "a3_froc", "a4_harmonized_froc", "a6_grade_summary", "a8_grade_auroc", "a11_seg_dice_global",
    "a13_lesion_dice", "a15_threshold_froc", "w1_cumulative_by_score", "w2_tie_grouped_curve", "v3_instance_volume",
    "v4_intensity_stats", "v7_connected_components", "v10_containment", "v13_outside_distance", "q4_check_splits",
    "q13_store_drift", "p1_group_kfold", "p7_foreground_sampler", "p12_cluster_bootstrap", "p13_paired_bootstrap_delta",
    "p15_fit_temperature", "t1_arrival_completeness", "t2_incremental_evaluation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, cpus, memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["j3_greedy_match"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
