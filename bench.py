"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from foliant.queries import QUERIES
from foliant.session import local_session

HEADLINES = (
    "scan_project_filter", "pricing_summary", "join_filtered_aggregate", "running_window", "set_operations", "document_frequency", "bm25_topk", "bm25_restricted",
    "dense_cosine_topk", "rrf_fuse", "paper_query_score", "paper_select", "recall_and_mrr", "neighbor_window", "token_budget_prefix", "fraction_overlap", "ngram_leak", "tree_descendants",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    for table in ("lineitem", "documents", "embeddings"):  # code and files are warm for all queries alike
        spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    times = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
