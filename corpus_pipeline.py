"""From raw documents to packed sequences: quality classifier, exact dedup, near-dedup, packing.

Cases: a null text counts as empty in every stage; blank texts have no words and no near copies.
Rows with one text are reduced to one, whatever their ids, also null or repeated ones. Very long
texts are judged and packed whole. Other columns go through all stages but the last unchanged, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from diffspark.llm import byte_bpe, exact_dedup, near_dedup, packing, quality
from diffspark.llm.common import table
from diffspark.stage import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier samples."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    with exact_dedup.DigestIndex(spark) as index:
        return exact_dedup.keep_first(docs, index)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return near_dedup.keep_one(docs, percent=80, size=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path(byte_bpe.FILE)).drop("ids")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]

ORACLE_SQL = None  # SQL cannot express the trained, hashed and tokenised stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
