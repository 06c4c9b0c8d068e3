"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query wall seconds.

Each query is forced to completion with the ``noop`` sink (full compute, no
driver collect). The first query pays JVM and Python-worker start-up, so a
warm-up query runs first and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "build_chunks", "chunk_sentences", "quality_gates", "clean_document_text", "detect_language",
    "match_rules", "embed_hashing", "knn_centroids", "knn_self", "bm25", "hybrid", "retrieve",
    "page_documents", "page_records", "page_structured", "index_sync", "stream_sync", "knn_lsh", "ask_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from quire.plans.registry import queries
    from quire.session import drop_tables, local_session

    spark = local_session(cpus)
    qs = queries()
    qs["clean_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        drop_tables(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
