"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept. Its rows are written as Parquet and read again for the next.
All but the last return the columns of ``documents``. Extra columns pass whatever
their names, empty tables give empty ones, and texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardflow.llm import (
    jaccard_join,
    line_cleaning,
    packing,
    quality_rules,
    secret_forest,
)
from wardflow.session import settle

QUALITY_SCORE = 0.3


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines; drop documents that fail or lose too much.

    Null, empty and short texts fail. Repeated rows are judged each.
    """
    return line_cleaning.kept_documents(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is low.

    Every row is scored, those with a null id, and null texts (as empty), too.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.kept_documents(docs, quality_rules.train(docs, labels), QUALITY_SCORE)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that with the smallest id.

    Texts without words are no duplicates and stay; of repeated rows one stays.
    """
    return jaccard_join.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets; no document goes. Null and empty texts stay as they are."""
    return secret_forest.masked(docs, secret_forest.train(secret_forest.labelled_findings(spark)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens into sequences: one row per piece.

    A null or empty text is an end token. Rows with equal or null ids are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

# Trained models, tokenizer and plan cannot be written in SQL. The tests run the stages
# and the whole on a small corpus whose results are known.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
