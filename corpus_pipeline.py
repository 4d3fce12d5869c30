"""The corpus pipeline: quality, exact copies, near copies, mixing, pieces.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read back as the next one's
documents. All but the last return the columns of ``documents``; others are left
out. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import exact_dedup, mixing, piece_codec, quality_classifier, simhash
from tidewater.llm.common import stage, table
from tidewater.llm.queries import PIECES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Rows without a doc_id stay if any
    of them is accepted; of repeated rows all stay or go. Without labels of both
    classes all stay."""
    return quality_classifier.drop_low_quality(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest
    doc_id. Null text is empty text; repeated rows are one."""
    return exact_dedup.drop_exact_duplicates(docs).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies (fingerprints linked by
    at most three bits). Rows without a doc_id stay."""
    return simhash.drop_near_duplicates(docs).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; documents
    without words are taken with the rest of their source or not at all. A null
    source is one of its own."""
    return mixing.mixed_documents(docs).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces; null and empty texts have none."""
    return piece_codec.with_pieces(docs.select(COLUMNS), public_tokenizers.path(PIECES))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixed", mixed), ("pieces", pieces)]

#: Fitted models, hashes and pieces: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
