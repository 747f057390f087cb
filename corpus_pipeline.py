"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again.

Defined results: null and empty texts fail the quality rules and go; texts of any length go through whole; rows with the same doc_id are one document to line
dedup and near-dedup and rows of their own to all else; ties are settled by each operator as it says; without labels of both classes only the fixed quality
rules decide; extra columns, whatever their names, are kept up to the last stage; an empty table gives no rows. Only the last stage returns other columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import common, line_dedup, minhash, mixing, quality_rules, sentencepiece_nbest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; fitted on the labelled rows among docs."""
    common.small_batches(spark)
    return quality_rules.kept_documents(docs, quality_rules.fit(docs, common.table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; those of which nothing is left go."""
    common.small_batches(spark)
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity of 0.8 or more)."""
    common.small_batches(spark)
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left, with the scores of the four best segmentations."""
    common.small_batches(spark)
    return sentencepiece_nbest.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing", mix), ("SentencePiece", encode)]
#: The quality trees and segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
