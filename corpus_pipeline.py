"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, packing.

Nulls and edge cases, for all stages: a null text is an empty one and stays null; rows with a null ``doc_id`` are judged by their own
text and never are anyone's duplicate; rows that repeat a ``doc_id`` are judged by their own text, except that near-duplicates stay or go
together; an empty table gives an empty one with the same columns (packing: no pieces); other columns are carried along, whatever their
names, up to packing. Without labels of both classes nothing is toxic, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fundloom.llm import decontaminate, neardup, packing, secrets, toxicity
from fundloom.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those that share four fifths of their shingles or more."""
    return neardup.without_near_duplicates(docs, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in them replaced by a mark."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; an empty text is one piece of one token."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]
#: The trained toxicity model cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
