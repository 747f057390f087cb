"""Live progress of a running build, and ledgers that hold each record once whatever fails."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException


class LiveProgress(StreamingQueryListener):
    """Counters of a build that runs as a stream, told while it runs.

    ``watch`` puts the counters into the plan, where the rows pass anyway; each micro-batch's come with the engine's progress event, with no job of their own. They are summed
    up, and ``report`` gets a record whenever another ``every`` rows have been processed, and one at the end. A build that goes on gives what was told before as ``told``.
    """

    def __init__(self, counters: dict[str, Column], every: int, report: Callable[[dict], None], told: dict | None = None) -> None:
        if every <= 0:
            raise ValueError("progress is told every so many rows, at least one")
        self.counters, self.every, self.report = counters, every, report
        self.sums = {"processed": 0, **dict.fromkeys(counters, 0)} | {k: v for k, v in (told or {}).items() if k in ("processed", *counters)}
        self.name, self.run, self.steps, self.latest = f"progress-{id(self)}", None, 0, None
        self.ended = threading.Event()

    def watch(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self.name, F.count(F.lit(1)).alias("processed"), *[F.count_if(c).alias(n) for n, c in self.counters.items()])

    def onQueryStarted(self, event) -> None:  # noqa: N802 (Spark's names)
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get(self.name)
        if found is None:
            return
        self.run, before = event.progress.runId, self.sums["processed"]
        for k in self.sums:
            self.sums[k] += found[k] or 0
        self.steps += 1
        if self.sums["processed"] // self.every > before // self.every:
            self._tell(done=False)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self.run in (None, event.runId):
            self._tell(done=event.exception is None)
            self.ended.set()

    def _tell(self, done: bool) -> None:
        record = {**self.sums, "steps": self.steps, "done": done}
        if record != self.latest:
            self.latest = record
            self.report(record)


def watched(rows: DataFrame, progress: LiveProgress, start: Callable[[DataFrame], object], patience: float = 60.0) -> dict:
    """Run a stream, started by ``start``, to its end with its progress told; gives the last record."""
    streams = rows.sparkSession.streams
    streams.addListener(progress)
    try:
        start(progress.watch(rows)).awaitTermination()
        if not progress.ended.wait(patience):  # events come a little after the run itself
            raise TimeoutError("the engine told no end of the run")
    finally:
        streams.removeListener(progress)
    return progress.latest


class OnceLedger:
    """Records of a stream, by batch number, of which readers see those up to the last commit.

    A batch writes its records under its own number over whatever is there, so one that was killed, or is run again, adds nothing twice; the stream's checkpoint
    gives a batch that is run again the same rows. A commit follows every ``every`` batches and the end of a run; it is one file that appears whole.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, every: int = 32) -> None:
        if every <= 0:
            raise ValueError("a commit follows every so many batches, at least one")
        self.spark, self.path, self.every = spark, path, every
        # the schema of what is read; batches are a column of their own
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.written: int | None = None

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        batch.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/records/ledger_batch={number}")
        self.written = number
        if (number + 1) % self.every == 0:
            self.commit()

    def commit(self) -> None:
        """Let readers see all batches written so far."""
        if self.written is not None and self.written != self.committed():
            self.spark.range(1).select(F.lit(self.written).cast("long").alias("upto")).coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/commit={self.written}")

    def committed(self) -> int | None:
        """The last batch that readers see."""
        try:
            return self.spark.read.schema("upto long").json(f"{self.path}/commits/*").agg(F.max("upto")).head()[0]
        except AnalysisException:
            return None  # nothing yet

    def read(self) -> DataFrame:
        upto = self.committed()
        fields = StructType([*self.schema.fields, StructField("ledger_batch", LongType())])
        if upto is None:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).option("basePath", f"{self.path}/records").parquet(f"{self.path}/records").filter(F.col("ledger_batch") <= upto)


def run_ledger(rows: DataFrame, ledger: OnceLedger, checkpoint: str) -> None:
    """Put all that a stream has so far into a ledger; a run that fails leaves its commit to the next one."""
    rows.writeStream.foreachBatch(ledger.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    ledger.commit()
