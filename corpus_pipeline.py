"""The training-text pipeline over ``documents``: its stages, each written as Parquet and read again.

Every stage takes all rows that the one before it kept. All but the last return the columns of
``documents`` (``n_chars`` follows the text); the last returns the token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm import bpe, decontaminate, line_dedup, minhash, quality
from clientele.llm.inputs import table, unused, whole
from clientele.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie far from their language's reference go."""
    return quality.good_texts(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of three lines that an earlier text has are cut out; a text of which nothing is left goes."""
    lines, removed = unused(docs, "_lines"), unused(docs, "_removed")
    cleaned = line_dedup.dedup_lines(docs, counts=(lines, removed))
    left = cleaned.filter((F.col(removed) == 0) | whole(F.col("text")).rlike(r"[^ \t\r\n\f\x0b]"))
    return left.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded text."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: SQL expresses neither the references of the quality rules' distances nor byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; every result but the last is staged."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
