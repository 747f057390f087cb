"""Ledgers: append-only progress records, summarised in batch or as a stream."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Fixed value: states after which a name is not tried again.
SKIPPED_STATES = ("timeout", "deferred")


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A folder of JSON-lines files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def latest_status(records: DataFrame, *, name: str = "name", status: str = "status", order: str = "ordinal") -> DataFrame:
    """The last status of each name. Works on streams (output mode update or complete): state is one value per name."""
    return records.groupBy(name).agg(F.max_by(status, order).alias(status))


def completed(records: DataFrame, *, name: str = "name", status: str = "status") -> DataFrame:
    return records.filter(F.col(status).startswith("uploaded")).select(name).distinct()


def resumable_skips(records: DataFrame, *, name: str = "name", status: str = "status") -> DataFrame:
    """Names with any record that makes another try needless."""
    return records.filter(F.col(status).startswith("uploaded") | F.col(status).isin(*SKIPPED_STATES)).select(name).distinct()


def plan_uploads(names: DataFrame, done: DataFrame, only: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    left = names.join(done, "name", "left_anti")
    if only is not None:
        left = left.join(only, "name", "left_semi")
    ordered = left.orderBy("name")
    return ordered if limit is None else ordered.limit(limit)


def progress_summary(records: DataFrame, counters: list[str], *, order: str = "ordinal") -> DataFrame:
    """One row: records, the last one as JSON and the greatest of each counter (0 if none can be read)."""
    last = F.max_by(F.to_json(F.struct(*[c for c in records.columns if c != order])), order)
    return records.agg(F.count("*").alias("event_count"), last.alias("latest"), *[F.coalesce(F.max(F.col(c).try_cast("long")), F.lit(0)).alias(f"max_{c}") for c in counters])


def restarts(records: DataFrame, counter: str, *, key: list[str], order: str) -> DataFrame:
    """Per key, how often a counter fell below the last known value before it."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    fell = F.coalesce(F.col(counter) < F.last(counter, ignorenulls=True).over(w), F.lit(False))
    return records.withColumn("_fell", fell).groupBy(*key).agg(F.count("*").alias("event_count"), F.count_if("_fell").alias("restart_count"), F.coalesce(F.max(counter), F.lit(0)).alias(f"max_{counter}"))


def progress_records(rows: DataFrame, interval: int, counters: dict[str, Column], *, number: str = "ordinal") -> DataFrame:
    """A record after every ``interval`` rows by their number (from 0, without gaps) and after the last: processed rows and running counters.

    Rows are counted per interval first, so that running sums go over one row for each interval.
    """
    blocks = rows.groupBy(F.floor(F.col(number) / interval).alias("_block")).agg(F.count("*").alias("_n"), F.max(number).alias("last"), *[F.count_if(c).alias(n) for n, c in counters.items()])
    upto = W.orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    return blocks.select(F.sum("_n").over(upto).alias("processed"), "last", *[F.sum(n).over(upto).alias(n) for n in counters])


def worth_saving(record: Column, every: int = 32) -> Column:
    """Whether evaluation progress is to be saved: each 32nd row, window, frame or case, and the last; the first counter that runs decides."""
    out = F.lit(False)
    for kind in ("cases", "frames", "windows", "rows"):
        done, most = record[f"evaluated_{kind}"], record[f"max_{kind}"]
        out = F.when(done > 0, (done % every == 0) | F.coalesce(done >= most, F.lit(False))).otherwise(out)
    return out


def windowed_counts(events: DataFrame, *, time: str, group: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and group; on a stream, later records than ``late`` are dropped with their state."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), group).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, *, time: str, group: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), group).agg(F.count("*").alias("n"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; in local mode a temporary one where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def appended(rows: DataFrame) -> DataFrame:
    """Read all a stream has so far and give the rows it has let out, as Parquet beside its checkpoint."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "stream")
    run = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def drained(rows: DataFrame) -> None:
    """Run a job for what its tasks do, keeping no rows."""
    rows.write.format("noop").mode("overwrite").save()


def run_to_end(aggregate: DataFrame, key: list[str]) -> DataFrame:
    """Read all a stream has so far and give the last row of each key: updates are written per batch as Parquet, beside the stream's checkpoint."""
    spark, folder = aggregate.sparkSession, shared_folder(aggregate.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/updates/part={number}")

    run = aggregate.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    others = [c for c in aggregate.columns if c not in key]
    updates = spark.read.schema(StructType([*aggregate.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{folder}/updates")
    return updates.groupBy(*key).agg(F.max_by(F.struct(*others), "_batch").alias("_last")).select(*key, "_last.*")


def pair_stream(steps: DataFrame, *, key: str, step: str, value: str) -> DataFrame:
    """A stream of steps, in order per key, as (key, step, value, next_value): each row comes out once its next one is there.

    State per key is the last row. A row that repeats or precedes the last step is dropped as late.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = f"{key} long, {step} long, {value} string, next_{value} string"

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        made = []
        rows = pd.concat(list(batches)).sort_values(step)
        for s, v in zip(rows[step].tolist(), rows[value].tolist(), strict=True):
            if last is not None and s <= last[0]:
                continue
            if last is not None:
                made.append((group[0], last[0], last[1], v))
            last = (s, v)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(made, columns=[key, step, value, f"next_{value}"])

    return steps.select(F.col(key).cast("long").alias(key), F.col(step).cast("long").alias(step), F.col(value).cast("string").alias(value)).groupBy(key).applyInPandasWithState(run, out, f"{step} long, {value} string", "append", GroupStateTimeout.NoTimeout)
