"""Ledgers as streams give what they give in batch."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from tracemill.streaming import ledger


def run(stream, name, mode):
    stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()


def test_latest_status_over_batches(spark, tmp_path):
    rows = [("a", "failed", 0), ("b", "uploaded", 1), ("a", "uploaded_again", 2), ("c", "timeout", 3), ("b", "failed", 4)]
    for k, (name, status, ordinal) in enumerate(rows):
        (tmp_path / f"{k}.json").write_text(json.dumps({"name": name, "status": status, "ordinal": ordinal}) + "\n")
    run(ledger.latest_status(ledger.stream(spark, str(tmp_path), "name string, status string, ordinal long", 1)), "latest", "complete")
    assert {tuple(r) for r in spark.table("latest").collect()} == {("a", "uploaded_again"), ("b", "failed"), ("c", "timeout")}
    batch = spark.read.schema("name string, status string, ordinal long").json(str(tmp_path))
    assert {r.name for r in ledger.completed(batch).collect()} == {"a", "b"}
    assert {r.name for r in ledger.resumable_skips(batch).collect()} == {"a", "b", "c"}
    names = spark.createDataFrame([(n,) for n in "abcde"], "name string")
    assert [r.name for r in ledger.plan_uploads(names, ledger.completed(batch), limit=2).collect()] == ["c", "d"]


def test_summary_and_restarts(spark):
    rows = spark.createDataFrame([(0, "x", "3"), (1, "x", "bad"), (2, "x", "9"), (3, "x", "4")], "ordinal int, k string, n string")
    r = ledger.progress_summary(rows, ["n"]).head()
    assert (r.event_count, r.max_n, json.loads(r.latest)["n"]) == (4, 9, "4")
    counted = rows.withColumn("n", F.expr("try_cast(n AS int)"))
    assert ledger.restarts(counted, "n", key=["k"], order="ordinal").head()[1:] == (4, 1, 9)


def test_pairs_across_batches(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps({"g": g, "s": k, "v": f"{g}{k}"}) + "\n" for g in (1, 2)))
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files come in the order of their times
    steps = ledger.stream(spark, str(tmp_path), "g long, s long, v string", 1)
    run(ledger.pair_stream(steps, key="g", step="s", value="v"), "pairs", "append")
    assert {tuple(r) for r in spark.table("pairs").collect()} == {(g, k, f"{g}{k}", f"{g}{k + 1}") for g in (1, 2) for k in range(3)}


def test_windows(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("a", "2024-01-01 02:00:00")], "g string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in ledger.windowed_counts(rows, time="t", group="g").collect()) == [1, 2]
    assert ledger.session_counts(rows, time="t", group="g", gap="45 minutes").count() == 2
