"""A build that stops reading when its limits are reached: ranges of shards in widening steps, each cut where a row-by-row build would stop.

A step reads its shards alone (a filter on the partition column of the scan), finds for each split and task the place of the last row that still fits, writes
what is accepted up to there, then its counters. The next step starts from the counters that are written, so a build that was killed goes on where it was; a step
without counters is written anew. Per step the driver holds six places and the counters; no group is sorted or collected.

Order is (shard, ordinal). Games lie within one shard. A row is skipped, not rejected, once both tasks of its split are full; with ``max_rows`` all rows after the
max_rows-th row of the first task go unread, as that row ends the build.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import build

Place = tuple[int, int]  # shard, ordinal
COUNTERS = "step int, shards array<int>, done boolean, processed bigint, skipped bigint, accepted array<struct<split: string, task: string, n: bigint>>, rejected array<struct<reason: string, n: bigint>>"


def widening(shards: Sequence[int], first: int = 1, growth: int = 2, widest: int = 64) -> Iterator[list[int]]:
    """Ranges of shards: ``first``, then ``growth`` times as many each time, up to ``widest``."""
    at, size = 0, first
    while at < len(shards):
        yield list(shards[at : at + size])
        at, size = at + size, min(widest, size * growth)


def _at(place: Place) -> Column:
    return F.struct(F.lit(place[0]).cast("long").alias("shard_index"), F.lit(place[1]).cast("long").alias("ordinal"))


def _accepted(task: str) -> Column:
    """Whether a row is one of the task, quotas aside."""
    return build.reason(F.col("split"), F.col("n_actions"), F.col("next_value") if task == "next_frame" else None).isNull()


def _ends(rows: DataFrame, left: dict[tuple[str, str], int]) -> dict[tuple[str, str], Place | None]:
    """Place of the last row that fits into each cell; None where rows run out first. Cells that are full have no place and are left out."""
    most = max(left.values())
    if most == 0:
        return {}
    tasks = sorted({t for _, t in left})
    tagged = rows.select("split", F.struct(F.col("shard_index").cast("long").alias("shard_index"), F.col("ordinal").cast("long").alias("ordinal")).alias("_at"), F.explode(F.array(*[F.when(_accepted(t), F.lit(t)) for t in tasks])).alias("task"))
    # the constant bound lets every task of the scan keep its first rows only
    first = tagged.filter("task IS NOT NULL").withColumn("_k", F.row_number().over(W.partitionBy("split", "task").orderBy("_at"))).filter(F.col("_k") <= most)
    wanted = F.element_at(F.create_map(*[x for (s, t), n in left.items() for x in (F.lit(f"{s}/{t}"), F.lit(n))]), F.concat_ws("/", "split", "task"))
    found = first.filter(F.col("_k") == wanted).select("split", "task", "_at.*").collect()  # six rows at most
    out: dict[tuple[str, str], Place | None] = {cell: None for cell, n in left.items() if n > 0}
    return out | {(r["split"], r["task"]): (r["shard_index"], r["ordinal"]) for r in found}


def _end(rows: DataFrame, task: str, left: int) -> Place | None:
    last = rows.filter(_accepted(task)).orderBy("shard_index", "ordinal").limit(left).agg(F.max(F.struct("shard_index", "ordinal")).alias("m"), F.count("*").alias("n")).head()
    return (last["m"]["shard_index"], last["m"]["ordinal"]) if last["n"] == left else None


class _Step:
    """Conditions on the rows of one step."""

    def __init__(self, rows: DataFrame, tasks: Sequence[str], limits: dict[str, int] | None, max_rows: int | None, counts: dict[tuple[str, str], int]) -> None:
        at = F.struct(F.col("shard_index").cast("long").alias("shard_index"), F.col("ordinal").cast("long").alias("ordinal"))
        self.open: dict[str, Column] = {t: F.lit(True) for t in tasks}
        self.read, self.done = F.lit(True), False
        if max_rows is not None:
            end = _end(rows, tasks[0], max_rows - sum(n for (_, t), n in counts.items() if t == tasks[0]))
            if end is not None:
                self.read, self.done = at <= _at(end), True
        elif limits is not None:
            cells = [(s, t) for s in build.SPLITS for t in tasks]
            ends = _ends(rows, {c: limits[c[0]] - counts.get(c, 0) for c in cells})
            for t in tasks:
                own = F.lit(False)
                for s in build.SPLITS:
                    if (s, t) in ends:
                        end = ends[s, t]
                        own = F.when(F.col("split") == s, F.lit(True) if end is None else at <= _at(end)).otherwise(own)
                self.open[t] = own
            if None not in ends.values():
                self.read, self.done = at <= _at(max(ends.values())), True
        open_any = F.lit(False)
        for t in tasks:
            open_any = open_any | self.open[t]
        self.skipped = F.col("split").isNotNull() & ~open_any
        mapped = build.reason(F.col("split"), F.col("n_actions"))
        late = F.lit(None).cast("string")
        if "next_frame" in tasks:
            late = F.when(self.open["next_frame"] & F.col("next_value").isNull(), "missing_next_observation")
        self.rejected = F.when(self.skipped, None).otherwise(F.coalesce(mapped, late))


def _told(spark: SparkSession, path: str) -> list[Row]:
    """Counters of the steps that are written, in order."""
    try:
        return spark.read.schema(COUNTERS).json(f"{path}/steps/*").orderBy("step").collect()  # a row for each step
    except AnalysisException:
        return []  # nothing yet


def progressive_build(
    scan: DataFrame,
    path: str,
    *,
    shards: Sequence[int],
    prepare: Callable[[DataFrame], DataFrame],
    tasks: Sequence[str] = build.TASKS,
    limits: dict[str, int] | None = None,
    max_rows: int | None = None,
    first: int = 1,
    growth: int = 2,
    widest: int = 64,
    progress: Callable[[dict], None] | None = None,
) -> list[dict]:
    """Build into ``path``/rows (partitioned by step, split and task) from as few shards as the limits need; gives the counters of all steps.

    scan has the partition column shard_index; ``prepare`` makes of some shards' rows transitions with shard_index, ordinal, split, n_actions, next_value and
    whatever the rows are to hold. Shards after the last step are never opened.
    """
    build.limit_contract(max_rows, limits)
    spark = scan.sparkSession
    told = [r.asDict(recursive=True) for r in _told(spark, path)]
    for step, own in enumerate(widening(shards, first, growth, widest)):
        if step < len(told):
            if told[step]["shards"] != own:
                raise ValueError("the build under this path was begun with other shards or steps")
            continue
        if told and told[-1]["done"]:
            break
        counts: dict[tuple[str, str], int] = {}
        for record in told:
            for c in record["accepted"]:
                counts[c["split"], c["task"]] = counts.get((c["split"], c["task"]), 0) + c["n"]
        rows = prepare(scan.filter(F.col("shard_index").isin(*own)))
        it = _Step(rows, tasks, limits, max_rows, counts)
        seen = rows.filter(it.read)
        made = seen.withColumn("task", F.explode(F.array_compact(F.array(*[F.when(_accepted(t) & it.open[t], F.lit(t)) for t in tasks]))))
        made.write.mode("overwrite").partitionBy("split", "task").parquet(f"{path}/rows/step={step}")
        # counted from what is written: a task that ran twice counts once
        written = spark.read.schema(made.schema).parquet(f"{path}/rows/step={step}").groupBy("split", "task").agg(F.count("*").alias("n"))
        accepted = [r.asDict() for r in written.collect()]
        reasons = seen.groupBy(it.rejected.alias("reason"), it.skipped.alias("skipped")).agg(F.count("*").alias("n")).collect()  # a row for each reason
        record = {
            "step": step, "shards": own, "done": it.done, "processed": sum(r["n"] for r in reasons), "skipped": sum(r["n"] for r in reasons if r["skipped"]),
            "accepted": sorted(accepted, key=lambda r: (r["split"], r["task"])), "rejected": [{"reason": r["reason"], "n": r["n"]} for r in reasons if r["reason"] is not None],
        }
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/steps/step={step}")
        told.append(record)
        if progress is not None:
            progress(record)
    return told


def built(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the steps whose counters are written, with step, split and task."""
    done = [r["step"] for r in _told(spark, path)]
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/step={s}" for s in done])


def totals(told: list[dict]) -> dict:
    """Sums over steps: shards read, processed, skipped, accepted by (split, task) and rejected by reason."""
    out: dict = {"shards": sum(len(r["shards"]) for r in told), "processed": sum(r["processed"] for r in told), "skipped": sum(r["skipped"] for r in told), "accepted": {}, "rejected": {}}
    for record in told:
        for c in record["accepted"]:
            out["accepted"][c["split"], c["task"]] = out["accepted"].get((c["split"], c["task"]), 0) + c["n"]
        for c in record["rejected"]:
            out["rejected"][c["reason"]] = out["rejected"].get(c["reason"], 0) + c["n"]
    return out
