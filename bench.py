"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query is forced end to end with the ``noop`` sink (all rows computed, nothing
collected). ``build_index``, ``build_vector_index`` and ``build_gram_index`` (tables written once
per session) are timed separately, and so is ``classify_queries`` (the query log's validation, scope and
intent, also written once and shared by every search); a tiny warm-up on sf0.001 runs first so JVM start-up is not billed to the
first query."""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = ["semantic_search", "keyword_search", "hybrid_search", "routed_search", "response_envelope",
            "knn_topk", "cosine_pairs", "keyword_join", "parallel_chapter", "read_chapter", "embed_corpus",
            "corpus_flatten", "dedup_last", "conversation_search"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from lectio import fixtures
    from lectio.catalog import QUERIES
    from lectio.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, d: str) -> float:
        t = time.perf_counter()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        run("semantic_search", warm)

    times: dict[str, float] = {}
    t = time.perf_counter()
    fixtures.passages(spark, sf_dir)
    times["build_index"] = round(time.perf_counter() - t, 3)
    for name, build in (("build_vector_index", fixtures.vector_index), ("build_gram_index", fixtures.gram_index)):
        t = time.perf_counter()
        build(spark, sf_dir)
        times[name] = round(time.perf_counter() - t, 3)
    t = time.perf_counter()
    fixtures.search_context(spark, sf_dir)
    times["classify_queries"] = round(time.perf_counter() - t, 3)
    for name in HEADLINE:
        times[name] = round(run(name, sf_dir), 3)

    n_queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    n_conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "n_queries": n_queries,
        "routed_queries_per_sec": round(n_queries / times["routed_search"], 2) if times["routed_search"] else None,
        "conversation_queries": n_conv,
        "conversation_queries_per_sec": round(n_conv / times["conversation_search"], 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
