"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` an optional comma-separated list of query names. Results go to
the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from moderata.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "labelled_docs",
    "concat_sources",
    "dataset_twitter",
    "dataset_berkeley",
    "shuffle_order",
    "split_exact",
    "split_stratified",
    "batch_ids",
    "length_stats",
    "vocab_build",
    "encode_fixed",
    "html_to_text",
    "chunk_documents",
    "tfidf_index",
    "topk_dense",
    "topk_sparse",
    "rag_augment",
    "kto_examples",
    "dpo_pairs",
    "nb_train",
    "nb_predict",
    "accuracy_rollup",
    "accuracy_cube",
    "epoch_elapsed",
    "progress_rows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("moderata-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
