"""The operators as queries over the given tables: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderata.llm import (
    decontamination, language_crf, line_dedup, lm_scoring, ordinal, packing, prefix_trie, quality_rules, sharding, simhash,
    warc, whitening, wrappers,
)

TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents", "doc_id", "text", "lang"))


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


@query
def op7_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    records, _ = warc.archive_and_read(table(spark, folder, "pages", "page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shard(table(spark, folder, "documents", "doc_id", "text"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontamination.digest(decontamination.scan(docs, table(spark, folder, "benchmark", "item_id", "text")))


@query
def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return lm_scoring.score(docs, lm_scoring.fit(docs))


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    model = ordinal.fit(docs, table(spark, folder, "labels", "doc_id", "quality", "toxic"))
    return ordinal.with_grades(docs, model).drop("text")


@query
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract_pages(table(spark, folder, "pages", "page_id", "url", "html"))


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, folder, "documents", "doc_id", "text"))


@query
def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    tagged = language_crf.tag(docs.select("doc_id", "text"), language_crf.fit(docs), spans=False)
    held_out = F.coalesce(~language_crf.training_row(F.col("doc_id")), F.lit(False)).alias("held_out")
    return tagged.select("doc_id", held_out, "lang_pred", "score")


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))
