"""Benchmark the headline queries.

Runs each query on the tables in $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints one JSON line. Each query is executed in
full (noop sink, no collect); fast queries report the median of 3 warm runs
after one warm-up, slow iterative/ML queries a single run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearth.plans.registry import QUERIES, load_all  # noqa: E402
from hearth.session import local_session  # noqa: E402

FAST = ["extract_star", "credits_pivot", "budget_latest", "budget_latest_literal",
        "consistency_check", "fit_threshold", "fit_threshold_by_group", "roc_auc",
        "knn_impute", "knn_classify", "encode_categories", "describe_clusters"]
SLOW = ["knn_impute_columns", "knn_join", "knn_lsh", "threshold_held_out", "micro_cluster", "ward_cut", "refine_kmeans",
        "rf_oof", "gbt_oof", "svm_oof", "knn_oof"]


def run(spark, name, sf_dir):
    t = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="hearth-bench")
    load_all()
    out = {}
    for name in FAST + SLOW:
        if only and name not in only:
            continue
        if name in FAST:
            run(spark, name, sf_dir)
            out[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(3)), 3)
        else:
            out[name] = round(run(spark, name, sf_dir), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "sum_of_query_seconds", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": float(sf) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
