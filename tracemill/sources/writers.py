"""Writers: partitioned datasets, JSON lines and one-row reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rows(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Rows partitioned by split and task: reading a split gives what a combined file would, a task what a task file would."""
    rows.write.partitionBy("split", "task").format(fmt).mode("errorifexists").save(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    rows.select(*sorted(rows.columns)).write.json(path)


def report_text(report: DataFrame) -> str:
    """A one-row report as indented JSON with sorted keys."""
    row = report.select(F.to_json(F.struct("*")).alias("j")).head()
    return json.dumps(json.loads(row["j"]), indent=2, sort_keys=True) + "\n"


def write_report(report: DataFrame, path: str) -> None:
    """report_text as a file of a shared folder, by way of Spark's own writer."""
    spark = report.sparkSession
    spark.createDataFrame([(report_text(report).rstrip("\n"),)], "value string").coalesce(1).write.text(path)


def write_action_manifest(actions: DataFrame, path: str, env_id: str) -> None:
    """actions(ordinal, action_id, nle_action_name, raw_key_code, key_label) as one JSON document."""
    fields = ("action_id", "nle_action_name", "raw_key_code", "key_label")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    actions.agg(entries.alias("entries")).select(F.to_json(F.struct(F.lit(env_id).alias("env_id"), "entries"))).coalesce(1).write.text(path)


def write_session(steps: DataFrame, path: str, *, order: str = "step", frame: str = "frame") -> None:
    """A session of play: its steps as JSON lines in order, and its frames as text, one after another, each under its number."""
    own = steps.orderBy(order)
    own.write.json(f"{path}/events")
    own.select(F.concat(F.lit("--- "), F.col(order).cast("string"), F.lit("\n"), frame)).write.text(f"{path}/frames")


def concatenated(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Rows of all parts, each with shard_index and ordinal; the first ``limit`` of them in that order."""
    tagged = [p.withColumn("shard_index", F.lit(k)) for k, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out if limit is None else out.orderBy("shard_index", "ordinal").limit(limit)


def with_new_root(roots: DataFrame, root: str) -> DataFrame:
    return roots.withColumn("root", F.lit(root))


def save_player_index(recordings: DataFrame, table: str, buckets: int = 32) -> None:
    """Recordings bucketed by player: later joins on it need no shuffle."""
    recordings.write.bucketBy(buckets, "player").sortBy("player").mode("overwrite").saveAsTable(table)
