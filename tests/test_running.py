"""Running histories on a stream give what windows give in batch: over batches out of order, restarts and repeated files."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import history
from tracemill.streaming import ledger, running

FIELDS = "game long, step long, at timestamp, text string, action int"


def put(folder, name: int, rows) -> None:
    path = folder / f"{name}.json"
    path.write_text("".join(json.dumps({"game": g, "step": s, "at": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}.000Z", "text": x, "action": a}) + "\n" for g, s, t, x, a in rows))
    os.utime(path, (1_700_000_000 + name, 1_700_000_000 + name))


def run(spark, source, out, state, **options) -> None:
    steps = ledger.stream(spark, str(source), FIELDS, 1)
    made = running.running_history(steps, game="game", step="step", time="at", items=["step", "text", "action"], **options)
    made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def told(df):
    return sorted((r.game, r.step, r.text, r.action, [tuple(x) for x in r.history]) for r in df.collect())


def batch(spark, source):
    rows = spark.read.schema(FIELDS).json(str(source)).filter("game > 0").distinct()
    return told(history.with_history(rows, game="game", order=["at", "step"], items=["step", "text", "action"]))


@pytest.fixture
def folders(tmp_path):
    for name in ("in", "out", "state"):
        (tmp_path / name).mkdir()
    return tmp_path / "in", tmp_path / "out", tmp_path / "state"


def test_histories_over_batches_and_a_restart(spark, folders):
    source, out, state = folders
    rng = random.Random(5)
    rows = [(g, s, 30 + 2 * s + g, None if rng.random() < 0.1 else f"t{g}-{s}", rng.choice([None, s])) for g in (1, 2, 3) for s in range(40)]
    rows.sort(key=lambda r: r[2] + rng.randrange(-4, 5))  # out of order by less than the watermark allows
    parts = [rows[k : k + 30] for k in range(0, len(rows), 30)]
    for k, part in enumerate(parts[:2]):
        put(source, k, part)
    run(spark, source, out, state, late="20 seconds")
    first = told(spark.read.parquet(str(out)))
    assert 0 < len(first) < 60
    # a file that comes again, the rest, and a step far ahead that lets all out
    put(source, 2, parts[1][-5:])
    for k, part in enumerate(parts[2:]):
        put(source, 3 + k, part)
    put(source, 9, [(-1, 0, 3000, "tick", 0)])
    run(spark, source, out, state, late="20 seconds")
    got = [r for r in told(spark.read.parquet(str(out))) if r[0] > 0]
    assert got == batch(spark, source) and len(got) == 120 and max(len(r[4]) for r in got) == 16


def test_still_games_are_forgotten_and_late_steps_dropped(spark, folders):
    source, out, state = folders
    put(source, 0, [(1, 0, 10, "a", 0), (1, 1, 11, "b", 1), (2, 0, 12, "x", 0)])
    put(source, 1, [(3, 0, 300, "y", 0)])
    put(source, 2, [(1, 2, 301, "c", 2), (1, 3, 20, "late", 3), (2, 1, 302, "z", 1)])
    put(source, 3, [(-1, 0, 900, "tick", 0)])
    run(spark, source, out, state, late="5 seconds", still="60 seconds")
    got = {(r[0], r[2]): [x[1] for x in r[4]] for r in told(spark.read.parquet(str(out))) if r[0] > 0}
    assert got == {(1, "a"): [], (1, "b"): ["a"], (2, "x"): [], (3, "y"): [], (1, "c"): [], (2, "z"): []}


def test_streamed_query_is_the_batch(spark):
    from tests.conftest import SMALL
    from tracemill.plans import queries as plans

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    want = history.with_history(events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))), game="user_id", order=["ms", "event_id"], items=["event_id"])
    want = {(r.event_id, ",".join(str(x.event_id) for x in r.history)) for r in want.collect()}
    assert {(r.event_id, r.items) for r in plans.QUERIES["streaming_history"](spark, SMALL).collect()} == want


class _Counted:
    """One state of a game or the handle of all, counting calls."""

    def __init__(self, calls=None):
        self.calls, self.kept = [] if calls is None else calls, []

    def __getattr__(self, name):
        if name.startswith("get") and name.endswith("State"):
            return lambda *a: _Counted(self.calls)
        put = {"put": lambda x: self.kept.__setitem__(slice(None), x), "update": lambda x: self.kept.__setitem__(slice(None), [x]), "appendValue": self.kept.append, "clear": self.kept.clear}
        read = {"get": lambda: list(self.kept) if self.kept and isinstance(self.kept[0][0], list) else next(iter(self.kept), None) or ()}
        return lambda *a: (self.calls.append(name), (put | read).get(name, lambda *a: None)(*a))[1]


def test_states_are_called_per_batch_not_per_step():
    import pandas as pd

    class Times:
        passed = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.passed

    handle, times = _Counted(), Times()
    made = running._Running(running.NEVER)
    made.init(handle)
    steps = [*range(100, 1000), *range(100)]
    rows = pd.DataFrame({"time_ms": [s + 1 for s in steps], "step": steps, "item": [f"i{s}" for s in steps]})
    for _ in range(2):  # the second time all come again
        list(made.handleInputRows((1,), iter([rows]), times))
    times.passed = 500
    first = pd.concat(made.handleExpiredTimer((1,), times, None))
    times.passed = 5000
    rest = pd.concat(made.handleExpiredTimer((1,), times, None))
    assert first["step"].tolist() == list(range(500)) and rest["step"].tolist() == list(range(500, 1000))
    assert rest["history"].tolist()[0] == [f"i{k}" for k in range(484, 500)]
    assert len(handle.calls) < 20
