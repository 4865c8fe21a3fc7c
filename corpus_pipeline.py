"""Documents to packed training sequences: five stages over whole tables.

Every stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and
returns them (the last one returns packed pieces).  ``run`` writes what a stage
returns as Parquet and reads it again for the next.  Columns whose names begin
with ``__op_`` belong to the stages; any other further columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm import language, ngram_join, packing, quality, secrets
from spanloom.llm.common import kept, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.5 or more.

    Null and empty texts are scored like any other; a null id takes no part in
    learning.  Repeated rows have equal scores.  Nothing is learned from an empty
    table, and an empty one comes back.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).filter("__op_score >= 0.5").drop("__op_score")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without a letter go, and so do texts between two languages, whatever their length.

    Repeated rows share their fate; an empty table comes back.
    """
    codes = language.learn(docs)
    found = docs.withColumn("__op_found", language.prediction(codes, F.col("text")))
    return found.filter("__op_found.lang_pred <> 'und' and not __op_found.ambiguous").drop("__op_found")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id.

    Rows with a null id, a null text or one without words all stay; several rows
    with one id count as one document, the one with the smallest text.
    """
    return ngram_join.deduplicate(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked; ``n_chars`` is counted anew (null for a null text).  Every row stays."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 4096 tokens; a null or empty text is its closing token, an empty table has no pieces."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False))


STAGES = [
    ("good_quality", good_quality),
    ("known_language", known_language),
    ("one_of_each_group", one_of_each_group),
    ("without_secrets", without_secrets),
    ("packed", packed),
]
#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
