"""Quality rules: gradient-boosted trees over document statistics.

Statistics of each whole text are taken in one pass over its bytes (bytes.split() cuts at space and 0x09-0x0D alone).
The trees are fitted on a bounded sample of labelled rows (``sample`` rows at most, chosen by a hash of the id), with
the score falling in the share of symbols, exclamation marks, capitals, repeated lines and repeated words. Their node arrays go to
the tasks, where batches of documents are scored at once.

Defined results: null text has no words, thus ``base_failed``; without labels of both classes the trees are a constant
and only ``base_failed`` decides; rows keep their multiplicity, null ids included; a score at the threshold passes; ids labelled twice take the larger
label; texts of any length are counted whole; columns other than doc_id and text are left out by ``apply``, whatever their names, and kept by ``kept_documents``; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, trees

SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = b"0123456789"
_NOT_START = bytes(range(0x80, 0xC0))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "chars_per_word", "symbols", "dup_lines", "repeat_words", "capitals", "digits", "exclamations", "letters", "distinct_words", "words_per_line")
#: Sign of the score's change as the feature rises.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeat_words": -1, "capitals": -1, "exclamations": -1}


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words that lie in a 3-word window found twice or more, distinct words)."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) < 4:
        return 0, len(number)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1].astype(np.int64) * len(number) + ids[2:]
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum()), len(number)


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The BASE counts and the FEATURES of one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0], [0.0] * len(FEATURES)
    word_chars = len(text.translate(None, common.SPACES + _NOT_START))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat, distinct = repeated_words(words)
    share = lambda kind: (len(text) - len(text.translate(None, kind))) / len(text)
    features = [
        float(np.log(n)), word_chars / n, symbols / word_chars, dup_lines / len(lines), repeat / n, share(_CAPITALS), share(_DIGITS),
        text.count(b"!") / word_chars, share(_LETTERS), distinct / n, n / len(lines),
    ]
    return [n, word_chars, symbols, dup_lines, repeat], features


def _with_statistics(docs: DataFrame) -> DataFrame:
    schema = "id long, label int, " + ", ".join(f"{c} double" for c in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t)[1] for t in batch.column(2).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))], names=["id", "label", *FEATURES])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, label: str = "quality", **options) -> trees.Trees:
    """Trees from at most ``sample`` labelled documents."""
    chosen = common.sampled_labels(labels, label, sample, hold_out=False)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").cast("binary").alias("body"))
    rows = rows.join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), "id").select("id", "label", "body")
    table = _with_statistics(rows).toPandas().sort_values(["id", *FEATURES], ignore_index=True)
    return trees.fit(table[list(FEATURES)].to_numpy(float), table["label"].to_numpy(float), monotone={FEATURES.index(k): v for k, v in MONOTONE.items()}, **options)


def apply(docs: DataFrame, model: trees.Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, BASE counts, score, base_failed, kept and the text of each row of docs."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", score double, base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [statistics(t) for t in batch.column(1).to_pylist()]
            counts = np.array([b for b, _ in both], dtype=np.int64).reshape(-1, len(BASE))
            score = model.score(np.array([f for _, f in both], dtype=float).reshape(-1, len(FEATURES)))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            kept = ~failed & (score >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(len(BASE))), pa.array(score), pa.array(failed), pa.array(kept)],
                names=["doc_id", *BASE, "score", "base_failed", "kept"],
            )
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("body")).mapInArrow(run, schema)


def kept_documents(docs: DataFrame, model: trees.Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that pass, columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [statistics(None if t is None else t.encode()) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            counts = np.array([b for b, _ in both], dtype=np.int64).reshape(-1, len(BASE))
            score = model.score(np.array([f for _, f in both], dtype=float).reshape(-1, len(FEATURES)))
            good = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0]) & (score >= threshold)
            yield batch.filter(pa.array(good))
        common.release()

    return docs.mapInArrow(run, docs.schema)
