"""Running histories: every step of a stream with the last 16 steps of its game before it, as state that survives restarts.

A game's state is its last place and items as one value, and the steps that wait for the watermark, packed by batch: steps may come out of order by as much as it allows. A timer at the earliest
waiting step lets out, in order, all that the watermark has passed; another forgets a game that has been still for long, so state doesn't grow with games
that have ended: a step that long after the one before begins anew. Steps later than the watermark are dropped, and so are steps at or before the last one let out (a file that is read twice adds nothing).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StructType

from ..operators.history import MAX_ITEMS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = 1 << 60


class _Running(StatefulProcessor):
    def __init__(self, still_ms: int) -> None:
        self.still_ms = still_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # each call of a state is a round trip to the JVM: what waits is packed by batch, what is held is one value
        self.waiting = handle.getListState("waiting", "times array<long>, steps array<long>, items array<string>")
        self.held = handle.getValueState("held", "time long, step long, items array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        earliest, passed = NEVER, timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            if passed > 0:  # the places before have been let out
                batch = batch[batch["time_ms"] > passed]
            if len(batch):
                times = batch["time_ms"].tolist()
                self.waiting.appendValue((times, batch["step"].tolist(), batch["item"].tolist()))
                earliest = min(earliest, *times)
        if earliest < NEVER:
            self.handle.registerTimer(earliest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        # a place that came again has its last item
        waiting = sorted({(t, s): x for packed in self.waiting.get() for t, s, x in zip(*packed, strict=True)}.items())
        ready = sum(place[0] <= passed for place, _ in waiting)
        time, step, held = self.held.get() or (-NEVER, -NEVER, [])
        if not waiting:
            if time + self.still_ms <= passed:
                self.waiting.clear()
                self.held.clear()
            return
        out, last, held = [], (time, step), list(held)
        for place, item in waiting[:ready]:
            if place > last:
                if place[0] - last[0] > self.still_ms:
                    held = []
                out.append((key[0], place[1], item, held))
                held = [*held, item][-MAX_ITEMS:]
                last = place
        if out:
            self.held.update((*last, held))
        if ready == len(waiting):
            self.waiting.clear()
            if self.still_ms < NEVER:
                self.handle.registerTimer(last[0] + self.still_ms)
        else:
            left = waiting[ready:]
            if ready:
                self.waiting.put([([p[0] for p, _ in left], [p[1] for p, _ in left], [x for _, x in left])])
            self.handle.registerTimer(left[0][0][0])
        if out:
            yield pd.DataFrame(out, columns=["game", "step", "item", "history"])

    def close(self) -> None:
        pass


def use_store(spark: SparkSession) -> None:
    """State of several kinds and timers need the RocksDB store; a session setting that queries read when they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def running_history(steps: DataFrame, *, game: str, step: str, time: str, items: Sequence[str], late: str = "0 seconds", still: str | None = None) -> DataFrame:
    """game, step, the items of the step and ``history``: the items of the last 16 steps of the game before it, oldest first.

    steps: a stream; ``late``: how much out of order steps may come; ``still``: after how long without steps a game is forgotten (never, unless given).
    """
    spark = steps.sparkSession
    use_store(spark)
    kinds = StructType([steps.schema[i] for i in items])
    still_ms = NEVER if still is None else int(pd.Timedelta(still).total_seconds() * 1000)
    packed = steps.withWatermark(time, late).select(
        F.col(game).cast("long").alias("game"), F.col(step).cast("long").alias("step"), F.unix_millis(F.col(time)).alias("time_ms"), F.to_json(F.struct(*items), {"ignoreNullFields": "false"}).alias("item"), F.col(time).alias("at")
    )
    told = packed.groupBy("game").transformWithStateInPandas(_Running(still_ms), outputStructType="game long, step long, item string, history array<string>", outputMode="Append", timeMode="EventTime")

    # the objects of a history are parsed at once, as one list
    history = F.from_json(F.concat(F.lit("["), F.array_join("history", ","), F.lit("]")), ArrayType(kinds))
    return told.select(F.col("game").alias(game), F.col("step").alias(step), F.from_json("item", kinds).alias("_own"), history.alias("history")).select(game, step, *[F.col(f"_own.{i}").alias(i) for i in items if i != step], "history")
