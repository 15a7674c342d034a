"""Corpus pipeline: quality classifier, near-duplicates, source mixing, BPE round trip.

Each stage works on all that the one before it kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import bpe, mixing, near_dedup, ordinal_quality
from latticework.llm.runtime import ship, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the ordinal classifier rejects.

    Every row is judged by its own text: null and empty ones score 0 words and
    stay or go by the threshold alone, repeated rows share their fate, null ids
    are judged like any, and an empty table stays empty.
    """
    ship(spark)
    return ordinal_quality.stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates.

    One row of each class stays: the smallest doc_id, nulls last, then by the
    text's key and the other columns, so repeated rows and rows without ids
    leave one.  Null texts count as empty; an empty table stays empty.
    """
    ship(spark)
    return near_dedup.stage(spark, docs, sf_dir)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Documents without words, null texts among them, stay once; null sources are
    one source; rows equal in doc_id, text and source share the copies of all of
    them; an empty table stays empty.
    """
    ship(spark)
    return mixing.stage(spark, docs, sf_dir)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each document and decode it again: doc_id, n_tokens and the digests of both.

    A row each, repeated ones too; null texts count as empty; an empty table
    gives no rows.
    """
    ship(spark)
    return bpe.code_column(docs, bpe.vocabulary_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: SQL cannot express the stages; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
