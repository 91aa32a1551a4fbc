"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from docsluice.plans import QUERIES
from docsluice.session import local_session

HEADLINE = [
    "chunks_per_source", "chunk_text_packed", "resume_filter", "top_k", "knn_join", "validate_results", "snapshot_warnings", "compliance_matrix",
    "assemble_corpus", "assemble_corpus_budget", "ground_claims", "ground_fields", "text_quality", "canonical_pick", "skip_existing", "tree_paths",
    "serial_numbers", "card_snapshot", "attachment_links", "structured_card", "price_coordination", "terms_gate_plan", "route_updates", "rag_prompt",
    "lenient_json",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=cpus, name="bench")
    spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_wall", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
