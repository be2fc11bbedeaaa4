"""A corpus pipeline of five of the training-data operators, each stage on all that the one before it kept.

``STAGES``: (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame. Between stages the rows are
written as Parquet and read again. All but the last give the columns of documents; the last gives packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import spill
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.language_id import keep_languages
from tidemark.llm.near_dedup import drop_near_copies
from tidemark.llm.packing import pack
from tidemark.llm.substring_dedup import cut_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the rest of the corpus teaches; ``und`` and hardly probable ones go."""
    return keep_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on two-word shingles, as operator 10's contract has it, the document with the smallest id stays."""
    return drop_near_copies(docs, k=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut."""
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, a row for each piece."""
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: Learned language weights, MinHash and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = spill(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
