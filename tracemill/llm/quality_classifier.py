"""Quality classifier: a sparse rule ensemble, compiled into Spark columns.

Statistics are built-in column expressions over the whole text. Shallow boosted trees on a bounded labelled sample
(``sample`` rows at most) propose rules: every path is a conjunction of intervals. Lasso logistic regression keeps few of
them; each kept rule becomes one boolean column expression, and the score is the logistic of their weighted sum.

Defined results: null text counts as empty and gets a score too; a null id is not held out; without labels of both
classes the score is the prior; rows keep their multiplicity; ids labelled twice take the larger label; texts of any length are
scored whole; columns other than doc_id and text are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, trees

STATISTICS = ("log_bytes", "bytes_per_word", "symbols", "exclamations", "capitals", "dup_lines", "distinct_words", "words_per_line", "pipes", "wide", "digits")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, label if there, STATISTICS; each in one or two scans of the text, none in Python."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    times = lambda c: F.octet_length(F.col("t")) - F.octet_length(F.replace(F.col("t"), F.lit(c)))
    kept = [c for c in ("doc_id", "label") if c in docs.columns]
    counted = docs.select(*kept, text.alias("t")).select(
        *kept,
        F.octet_length("t").alias("n_bytes"),
        F.char_length("t").alias("n_chars"),
        (times(" ") + times("\n") + 1).alias("n_words"),
        sum((times(c) for c in "#*$%&<>"), F.lit(0)).alias("n_symbols"),
        times("|").alias("n_pipes"),
        times("!").alias("n_exclamations"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("n_capitals"),
        F.regexp_count("t", F.lit("[0-9]+")).alias("n_digits"),
        F.split("t", "\n").alias("lines"),
        F.size(F.array_distinct(F.split("t", " "))).alias("n_distinct"),
    )
    counted = counted.withColumns({"n_lines": F.size("lines"), "n_lines_distinct": F.size(F.array_distinct("lines"))})
    size = F.greatest(F.col("n_bytes"), F.lit(1))
    return counted.select(
        *kept,
        F.log1p(F.col("n_bytes").cast("double")).alias("log_bytes"),
        (F.col("n_bytes") / F.col("n_words")).alias("bytes_per_word"),
        (F.col("n_symbols") / size).alias("symbols"),
        (F.col("n_exclamations") / size).alias("exclamations"),
        (F.col("n_capitals") / size).alias("capitals"),
        (1 - F.col("n_lines_distinct") / F.col("n_lines")).alias("dup_lines"),
        (F.col("n_distinct") / F.col("n_words")).alias("distinct_words"),
        (F.col("n_words") / F.col("n_lines")).alias("words_per_line"),
        (F.col("n_pipes") / size).alias("pipes"),
        (1 - F.col("n_chars") / size).alias("wide"),
        (F.col("n_digits") / size).alias("digits"),
    )


def compile_rules(found: list[trees.Rule], weights: np.ndarray, intercept: float) -> Column:
    """The score as one column expression."""

    def holds(rule: trees.Rule) -> Column:
        parts = [F.col(STATISTICS[f]) > F.lit(low) for f, low, _ in rule if np.isfinite(low)] + [F.col(STATISTICS[f]) <= F.lit(high) for f, _, high in rule if np.isfinite(high)]
        return reduce(lambda a, b: a & b, parts)

    terms = [F.when(holds(r), F.lit(float(w))).otherwise(F.lit(0.0)) for r, w in zip(found, weights, strict=True) if w]
    margin = reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))
    return 1.0 / (1.0 + F.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, penalty: float = 5e-4, label: str = "quality", rounds: int = 40, hold_out: bool = True) -> tuple[list[trees.Rule], np.ndarray, float]:
    """Rules, weights and intercept from at most ``sample`` labelled documents outside the held-out fold."""
    chosen = common.sampled_labels(labels, label, sample, hold_out=hold_out)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    table = rows.toPandas().sort_values(["doc_id", *STATISTICS], ignore_index=True)
    x, y = table[list(STATISTICS)].to_numpy(float), table["label"].to_numpy(float)
    found = trees.rules(trees.fit(x, y, rounds=rounds, depth=3, rate=0.3))
    intercept, weights = trees.lasso_logistic(trees.satisfied(found, x), y, penalty)
    return found, weights, intercept


def classify(docs: DataFrame, model: tuple[list[trees.Rule], np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    found, weights, intercept = model
    scored = with_statistics(docs.select("doc_id", "text")).withColumn("score", compile_rules(found, weights, intercept))
    return scored.select(
        "doc_id", F.coalesce(common.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
