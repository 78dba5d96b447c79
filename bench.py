"""Times headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, and
BENCH_QUERIES, if set, a comma-separated choice of queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from partatlas.plans.queries import QUERIES
from partatlas.session import local_session

HEADLINE = [
    "clean_items",
    "dataset_statistics",
    "distributions",
    "tfidf_weights",
    "description_similarity_pairs",
    "similar_pairs",
    "similarity_statistics",
    "item_similarity_profile",
    "best_description_match",
    "connected_components",
    "neighbour_pairs",
    "dbscan",
    "cluster_metrics",
    "kmeans_assign",
    "truncated_svd",
    "enrich_descriptions",
    "llm_fallback",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session("partatlas-bench")
    spark.read.parquet(f"{sf_dir}/part.parquet").count()  # start the executors before the clock
    times = {}
    for name in names:
        begin = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.monotonic() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
