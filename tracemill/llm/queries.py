"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, minhash, mixing, neighbours, pii, quality_classifier, quality_rules, repair, runs, sentencepiece_nbest, token_files
from .common import small_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sentencepiece_nbest.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, removed line numbers as text; those without lines that hold words have none removed."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.removed_lines(docs).withColumnRenamed("doc_id", "found_id")
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("found_id"), "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.array_join(F.transform("removed", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"),
    )


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.pseudonyms(table(spark, sf_dir, "documents"), key="public example key; a deployment passes its own")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 1000)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(rows.union(own), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(rows, repair.faulty(repair.damaged(rows)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return runs.report(runs.damaged(table(spark, sf_dir, "documents")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.report(decontaminate.located(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_line_dedup, op3_nearest_neighbours, op4_minhash_near_dedup, op5_quality_classifier,
        op6_mixing, op7_token_files, op8_pii, op9_chat, op10_quality_rules,
        op11_conversation_repair, op12_periodic_runs, op13_decontamination,
    )
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.LINES_SQL,
    "op4_minhash_near_dedup": minhash.NEAR_SQL,
    "op6_mixing": mixing.MIX_SQL,
    "op9_chat": chat.CHAT_SQL,
    "op11_conversation_repair": repair.REPAIR_SQL,
    "op13_decontamination": decontaminate.LEAK_SQL,
}
