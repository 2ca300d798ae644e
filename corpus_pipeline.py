"""Corpus pipeline: language ID, toxicity, exact dedup, SimHash near-dedup,
packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages
but the last return the columns of ``documents``. A stage is fitted on, and
decides about, the documents that its predecessor kept; the toxicity stage
also reads ``labels``. Null ids, null and empty texts, repeated rows, empty
tables and further columns are handled as the operators' docstrings say; a
stage keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from webtide.llm.common import table
from webtide.llm.exact_dedup import drop_exact_duplicates
from webtide.llm.langid import drop_rejected
from webtide.llm.packing import pack
from webtide.llm.simhash import drop_near_duplicates
from webtide.llm.toxicity import drop_toxic
from webtide.session import shared_path

#: Put after each document in the packed sequences.
END = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language is unknown or rejected."""
    return drop_rejected(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the largest id, of each group of equal texts."""
    return drop_exact_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of near copies."""
    return drop_near_duplicates(docs, words=3, radius=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), END)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("packing", packing),
]

#: Language ID and toxicity learn models, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, through tables in the shared folder."""
    folder = shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
