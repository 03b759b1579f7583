"""Headline queries, timed. Prints one JSON line.

Each workload is warmed up once and then run BENCH_RUNS times; the median counts. Results are
forced with the noop sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

# name in the catalog -> what it stands for
HEADLINES = {
    "bucket_avg": "average per five minutes, metric and instance",
    "pivot_series": "pivot to a wide frame",
    "join_chain_nodes": "per-host chain join",
    "label_intervals": "interval labelling",
    "scale_standard": "standard scaling, 4 columns",
    "scale_robust": "robust scaling from exact quantiles",
    "corr_pearson": "correlation matrix of a wide frame",
    "corr_spearman": "rank correlation, 4x4",
    "point_threshold": "threshold rules",
    "anomaly_islands": "anomalies merged to intervals",
    "hbos": "histogram outlier score",
    "isolation_forest": "isolation forest, 50 trees: fit and score",
    "dbscan": "density clustering of embeddings",
    "scores": "hard-label scores",
    "pr_curve": "precision-recall sweep",
    "clf_random_forest": "random forest: fit and predict",
    "cross_validate": "three-fold cross-validation",
}


def main() -> None:
    from metricloom.plans.catalog import QUERIES
    from metricloom.session import get_spark

    spark = get_spark(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
           "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or list(HEADLINES)
    found = {}
    for name in wanted:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        found[name] = round(statistics.median(times[1:]), 3)
        print(name, found[name], file=sys.stderr, flush=True)
    total = round(sum(found.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec",
                      "queries": found, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
