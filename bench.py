"""Time the headline queries on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from assetloom.session import local_session
from checks.queries import all_queries

HEADLINE = (
    "limit_prices",
    "date_grid",
    "split_two_way",
    "data_filter",
    "kpi_basic",
    "kpi_full",
    "asset_summary",
    "split_census",
    "holdings_replay",
    "customer_summary",
    "training_set",
    "recommend_ranked",
    "kpi_at_k_mean",
    "ndcg_at_k",
    "recommendation_run",
    "neg_multi",
    "weighted_sample",
    "graph_norm_adj",
    "graph_sym_norm",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # start the JVM's code paths once so that the first query is not charged for it
    queries["asset_roi"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
