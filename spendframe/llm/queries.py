"""The registered queries: each operator over its whole table, with its parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.llm import (
    decontamination, hard_negatives, language, lexical, licenses, mixing, ngram_join, packing, private, quality, sharding,
    toxicity, warc,
)
from spendframe.llm.frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return private.personal_data(table(spark, folder, "documents"))


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, folder, "documents"), width=3, percent=90)


def op5_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op7_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("content")


def op9_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    responses = warc.responses_of_pages(table(spark, folder, "pages"))
    records = warc.derive(responses, keep=["page_id"])
    return records.select("page_id", "record_id", "warc_type", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type",
                          "content_length", "block_digest", "source_digest", F.sha2("block", 256).alias("block_sha256"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "score")


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {query.__name__: query for query in (
    op1_language_id, op2_personal_data, op3_source_mixing, op4_ngram_join, op5_token_packing, op6_license_scan,
    op7_ring_shards, op8_decontamination, op9_warc_derivatives, op10_quality_rules, op11_ranked_search, op12_toxicity,
    op13_hard_negatives)}
