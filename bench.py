"""Time the headline queries at one scale and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from docloom.plans import QUERIES
from docloom.plans.corpus import GROUPS, benchmark_queries, stored_index
from docloom.session import build_session
from docloom.sources import inverted

HEADLINE = [
    "text_scalars", "exact_duplicates", "minhash_bands", "near_duplicates", "chunk_documents", "markdown_blocks", "merkle_roots", "delta_stats",
    "knn_topk", "knn_documents", "bm25_topk", "hybrid_search", "hybrid_retrieve", "search_facets", "suggest_titles", "did_you_mean",
    "list_orders_page", "folder_counts", "multi_get_ordered", "previous_version", "dirty_ancestors", "job_backoff", "conversation_history",
    "bm25_fuzzy", "duplicate_tiers", "eval_hit_rate", "knn_cells", "correct_phrases", "tag_suggestions",
]


def stored_search(spark, folder: str) -> dict[str, float]:
    """Seconds to write the inverted index of all documents, to answer all benchmark items from it, and to answer one."""
    times = {}

    def timed(name, run):
        started = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - started, 3)

    timed("build_inverted_index", lambda: stored_index(spark, folder))
    timed("bm25_stored", lambda: QUERIES["bm25_stored"](spark, folder).write.format("noop").mode("overwrite").save())
    one = benchmark_queries(spark, folder).orderBy("query_id").limit(1)
    timed("bm25_stored_one_question", lambda: inverted.topk(spark, stored_index(spark, folder), one, GROUPS, 8).collect())
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cores}]", int(cores))
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    times |= stored_search(spark, folder)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
