"""Progress is told while a build runs; ledgers hold each record once over kills and replays."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tracemill.streaming import ledger, progress

FIELDS = "ordinal long, name string, status string"


def put(folder, name: int, rows) -> None:
    path = folder / f"{name}.json"
    path.write_text("".join(json.dumps(dict(zip(("ordinal", "name", "status"), r, strict=True))) + "\n" for r in rows))
    os.utime(path, (1_700_000_000 + name, 1_700_000_000 + name))


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(6):
        put(folder, k, [(10 * k + j, f"n{j}", "failed" if j % 3 == 0 else "uploaded") for j in range(10)])
    return folder


def test_progress_is_told_while_the_build_runs(spark, source, tmp_path):
    seen = []
    folders = []

    def report(record):
        seen.append(record)
        folders.append(len(list((tmp_path / "out").glob("*.parquet"))))

    live = progress.LiveProgress({"rejected": F.col("status") == "failed"}, 20, report)
    rows = ledger.stream(spark, str(source), FIELDS, 1)
    start = lambda df: df.filter("status != 'failed'").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    last = progress.watched(rows, live, start)
    assert [(r["processed"], r["rejected"], r["done"]) for r in seen] == [(20, 8, False), (40, 16, False), (60, 24, False), (60, 24, True)]
    assert last == seen[-1] and last["steps"] == 6
    assert spark.read.parquet(str(tmp_path / "out")).count() == last["processed"] - last["rejected"]
    # a build that goes on tells on from there
    put(source, 7, [(60, "x", "failed")])
    again = progress.LiveProgress({"rejected": F.col("status") == "failed"}, 20, seen.append, told=last)
    assert progress.watched(rows, again, start)["processed"] == 61
    with pytest.raises(ValueError, match="at least one"):
        progress.LiveProgress({}, 0, seen.append)


def records(once):
    return sorted(tuple(r) for r in once.read().select("ordinal", "name", "status").collect())


@pytest.mark.parametrize("moment", ["before", "within", "after", "commit"])
def test_killed_batches_are_written_once(spark, source, tmp_path, moment):
    want = sorted((10 * k + j, f"n{j}", "failed" if j % 3 == 0 else "uploaded") for k in range(6) for j in range(10))
    rows = ledger.stream(spark, str(source), FIELDS, 1)

    class Killed(progress.OnceLedger):
        def write(self, batch, number):
            if number == 3 and moment == "before":
                raise RuntimeError("killed")
            if number == 3 and moment == "within":  # half a batch is there
                batch.limit(4).select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/records/ledger_batch={number}")
                raise RuntimeError("killed")
            super().write(batch, number)
            if number == 3 and moment == "after":
                raise RuntimeError("killed")

        def commit(self):
            if self.written == 3 and moment == "commit":
                raise RuntimeError("killed")
            super().commit()

    path, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    once = Killed(spark, path, FIELDS, every=2)
    assert records(once) == []
    with pytest.raises(Exception, match="killed"):
        progress.run_ledger(rows, once, state)
    seen = records(progress.OnceLedger(spark, path, FIELDS))
    assert seen == [r for r in want if r[0] < (40 if moment == "after" else 20)]  # what is committed, nothing of half a batch
    progress.run_ledger(rows, progress.OnceLedger(spark, path, FIELDS, every=2), state)
    assert records(progress.OnceLedger(spark, path, FIELDS)) == want


def test_commits_follow_every_few_batches_and_the_end(spark, source, tmp_path):
    once = progress.OnceLedger(spark, str(tmp_path / "ledger"), FIELDS, every=4)
    commits = []
    own = once.commit

    def commit():
        own()
        commits.append(once.committed())

    once.commit = commit
    progress.run_ledger(ledger.stream(spark, str(source), FIELDS, 1), once, str(tmp_path / "state"))
    assert commits == [3, 5]
    progress.run_ledger(ledger.stream(spark, str(source), FIELDS, 1), progress.OnceLedger(spark, str(tmp_path / "ledger"), FIELDS), str(tmp_path / "state"))  # nothing new
    assert once.read().count() == 60
    with pytest.raises(ValueError, match="at least one"):
        progress.OnceLedger(spark, "x", FIELDS, every=0)
