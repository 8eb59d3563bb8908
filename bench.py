"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

from kerf import registry
from kerf.plans.session import local_session

HEADLINE = ("sentence_pack", "chunk_stats_by_lang", "chunk_documents", "chunk_pages", "dedup_exact", "simhash_signature", "minhash_dedup", "chunk_diff", "hierarchy_levels", "budget_greedy", "graph_edges", "semantic_boundaries")


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    took = {}
    registry.QUERIES["doc_sizes"](spark, d).write.format("noop").mode("overwrite").save()  # starts the JVM's and Python's workers
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    # The reference's own figure is the throughput of prose: characters cut in a second.
    n = spark.read.parquet(f"{d}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"), "prose_mb_per_s": round(n / 1e6 / took["chunk_documents"], 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
