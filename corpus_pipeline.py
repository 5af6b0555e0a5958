"""A corpus cleaning run: each stage applies one operator of riskweave.llm to all that the stage before it kept.

Quality rules drop documents; line dedup takes recurring template lines out of texts; near-dedup keeps one document of
each group of word-shingle similarity 0.8 or more; decontamination drops documents that hold benchmark passages; encoding gives each document's token ids.

Defined results, for every stage: null and empty texts, null ids, repeated rows, very long texts and empty tables do not stop it, and further
columns may have any name. A null or empty text fails the quality rules; a text of nothing but dropped lines stays, empty; equal rows
are judged alike, and near-dedup keeps one of them (the smallest id, null last).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.common import shared_dir, table, temporary_tables
from riskweave.llm.decontamination import clean_documents
from riskweave.llm.jaccard_neardup import deduplicated
from riskweave.llm.line_templates import deduplicated_lines
from riskweave.llm.piece_transducer import encoded
from riskweave.llm.quality_rules import good_documents

#: Words of a shingle in the near-dedup stage.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated_lines(docs, chars_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, words=SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]

#: SQL cannot express the fingerprints and transducers; tests/llm holds the run against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
