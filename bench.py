"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "doc_freq",
    "bm25_topk",
    "bm25_filtered_topk",
    "dense_topk",
    "centroid_classify",
    "rrf_hybrid",
    "fusion_rrf",
    "fusion_intent_aware",
    "dedup_exact",
    "dedup_near_pairs",
    "boilerplate_lines",
    "chunk_sections",
    "chunk_statuses",
    "utterance_sessions",
    "ledger_lineage",
    "recall_precision_at_k",
    "verify_claims",
    "stop_reason",
    "intent_budget",
    "paired_effects_continuous",
    "asof_latest",
    "leakage_ngrams",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE

    from quarrymark.plans.catalogue import CATALOGUE
    from quarrymark.session import build_session
    from quarrymark.sources.tables import Tables

    spark = build_session(f"local[{cpus}]", "quarrymark-bench", shuffle_partitions=int(cpus), driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    tables.documents.count()  # start the task threads before the first measurement
    seconds: dict[str, float] = {}
    for name in only:
        start = time.perf_counter()
        CATALOGUE[name].build(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
