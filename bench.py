"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

#: What the published timings of retrieval, graph reranking and evaluation are about, an operator each.
HEADLINE = (
    "bm25_topk",
    "tfidf_cosine_topk",
    "hybrid_fusion",
    "dense_topk",
    "align_contains",
    "ir_metrics_macro_all",
    "chunk_words",
    "graph_edges",
    "typed_paths",
    "fusion_score",
    "expand_merge",
    "ppr_converged",
    "answer_eval",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.plans.catalog import QUERIES

    times = {}
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
