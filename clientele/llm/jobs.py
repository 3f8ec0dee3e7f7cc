"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm import bpe, conversation_repair, decontaminate, html_text, language, lexical_search, line_dedup, minhash, pii, quality, quality_classifier, sharding, training_order
from clientele.llm.inputs import table, whole
from clientele.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(table(spark, folder, "documents"))


@query
def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    items = F.concat_ws(",", F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), items.alias("item_ids"), F.round("similarity", 6).alias("similarity"))


@query
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, folder, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), words=4, percent=80)


@query
def op8_training_order(spark: SparkSession, folder: str) -> DataFrame:
    found = training_order.written(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "shards"))
    return found.select("doc_id", "part", "n_tokens", "slot", "shard", "byte_offset", "ids_crc32")


@query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, folder, "documents"), counts=("n_lines", "n_removed"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(whole(F.col("text")).cast("binary"), 256).alias("text_sha256"))


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents"))


@query
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversation_repair.repair_report(conversation_repair.damage(rows), rows.select("conv_id"))


@query
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


@query
def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
