"""Supervised rows from transitions: reasons for rejection, caps, the rows of both tasks, and merging shards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import action_text, list_text
from . import history, labels

#: Own version of the row format; prompts and the length limit are fixed values.
ROW_VERSION = "tracemill.row.v1"
POLICY_PROMPT = 'You control NetHack through NLE. Return only JSON: {"action_id": int}.'
FRAME_PROMPT = (
    "You predict NetHack transition dynamics from NLE traces. "
    "Return only the next rendered observation frame text. "
    "Begin with MAP: and include MESSAGE:, BLSTATS:, and INVENTORY: sections."
)
MAX_FRAME_CHARACTERS = 4096
SPLITS, TASKS = ("train", "validation", "test"), ("policy_action", "next_frame")


def key_map(actions: DataFrame, key: str = "raw_key_code", action: str = "action_id") -> DataFrame:
    """Per raw key how many actions it has and the smallest of them."""
    return actions.groupBy(key).agg(F.count("*").alias("n_actions"), F.min(action).alias(action))


def with_action(rows: DataFrame, keys: DataFrame, key: str = "raw_key_code") -> DataFrame:
    """rows with action_id (only where the key has one action) and n_actions. A key map is as small as a keyboard, so it is broadcast by its size."""
    mapped = keys.select(F.col(key).alias("_key"), "n_actions", F.col("action_id").alias("_action"))
    joined = rows.join(mapped, rows[key] == mapped["_key"], "left")
    return joined.withColumn("action_id", F.when(F.col("n_actions") == 1, F.col("_action"))).drop("_key", "_action")


def reason(split: Column, n_actions: Column, next_value: Column | None = None) -> Column:
    """Why a row is not accepted, the first that holds; for the next-frame task a missing next observation too. NULL: accepted."""
    out = F.when(split.isNull(), "gameid_not_in_split").when(n_actions.isNull(), "unmapped_raw_key_code").when(n_actions > 1, "ambiguous_raw_key_code")
    return out if next_value is None else out.when(next_value.isNull(), "missing_next_observation")


def accepted_by_task(rows: DataFrame) -> DataFrame:
    """Each row once per task with its reason; a row can be accepted for one task and rejected for the other."""
    tagged = rows.withColumn(
        "_t",
        F.array(
            F.struct(F.lit("policy_action").alias("task"), reason(F.col("split"), F.col("n_actions")).alias("reason")),
            F.struct(F.lit("next_frame").alias("task"), reason(F.col("split"), F.col("n_actions"), F.col("next_value")).alias("reason")),
        ),
    )
    return tagged.withColumn("_t", F.explode("_t")).select(*rows.columns, "_t.task", "_t.reason")


def capped(rows: DataFrame, limit: int, *, groups: Sequence[str] = ("split", "task"), order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """rows with ``over_quota``: whether they come after the first ``limit`` accepted rows of their split and task. ``order`` tells rows apart.

    The last row within a quota is found by a bounded top-k of each group; then rows are compared with it, and no group is sorted.
    """
    w = W.partitionBy(*groups).orderBy(*order)
    first = rows.select(*groups, F.struct(*order).alias("_at"), F.row_number().over(w).alias("_k")).filter(F.col("_k") <= limit)
    last = first.groupBy(*groups).agg(F.max("_at").alias("_last"), F.count("*").alias("_n")).select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(groups)], "_last", "_n")
    joined = rows.join(last, [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(groups)])
    return joined.withColumn("over_quota", (F.col("_n") == limit) & (F.struct(*order) > F.col("_last"))).select(*rows.columns, "over_quota")


def global_cap(rows: DataFrame, limit: int, *, order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Rows up to and with the ordinal of the ``limit``-th accepted policy row: where a build of both tasks ends.

    The ordinal is found with one top-k; no window runs over the whole table.
    """
    policy = rows.filter("task = 'policy_action' AND reason IS NULL")
    last = policy.orderBy(*order).limit(limit).agg(F.max(F.struct(*order)).alias("_last"), F.count("*").alias("_n"))
    # fewer policy rows than the limit: the build reads to the end
    return rows.crossJoin(F.broadcast(last)).filter((F.col("_n") < limit) | (F.struct(*order) <= F.col("_last"))).drop("_last", "_n")


def messages(system: str, user: Column, assistant: Column) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", user), ("assistant", assistant))])


def policy_row(rows: DataFrame, dataset: str, mode: str, valid_ids: Sequence[int], shown: Column, metadata: Column | None = None) -> DataFrame:
    """Rows of the policy task. rows has split, gameid, step, action_id, observation_text; ``shown`` is the history that the mode shows."""
    ids = F.array(*[F.lit(int(i)) for i in valid_ids])
    user = history.prompt(F.concat(F.lit("Allowed action_ids: "), list_text(ids)), F.col("observation_text"), shown)
    return _row(rows, dataset, mode, "policy_action", messages(POLICY_PROMPT, user, action_text(F.col("action_id"))), metadata)


def frame_row(rows: DataFrame, dataset: str, mode: str, shown: Column, metadata: Column | None = None) -> DataFrame:
    """Rows of the next-frame task; the frame is cut at 4,096 characters."""
    user = history.prompt(F.concat(F.lit("Action taken: "), action_text(F.col("action_id"))), F.col("observation_text"), shown)
    return _row(rows, dataset, mode, "next_frame", messages(FRAME_PROMPT, user, F.substring("next_text", 1, MAX_FRAME_CHARACTERS)), metadata)


def _row(rows: DataFrame, dataset: str, mode: str, task: str, made: Column, metadata: Column | None) -> DataFrame:
    sequence = F.col("sequence_id") if "sequence_id" in rows.columns else F.lit(None).cast("string")
    number = F.col("sequence_step") if "sequence_step" in rows.columns else F.lit(None).cast("int")
    return rows.select(
        F.lit(ROW_VERSION).alias("schema_version"),
        F.lit(dataset).alias("dataset_name"),
        "split",
        F.lit(task).alias("task"),
        F.lit(mode).alias("mode"),
        "gameid",
        F.concat_ws(":", F.lit(dataset), F.col("gameid").cast("string")).alias("episode_id"),
        "step",
        F.when(sequence.isNotNull(), F.concat_ws(":", F.lit(dataset), sequence)).alias("sequence_id"),
        F.when(sequence.isNotNull(), F.coalesce(number, F.col("step"))).alias("sequence_step"),
        made.alias("messages"),
        F.col("action_id").alias("action_id"),
        *([] if metadata is None else [metadata.alias("metadata")]),
    )


def pseudo_rows(rows: DataFrame, dataset: str, mode: str, valid_ids: Sequence[int], *, tasks: Sequence[str] = TASKS, token_budget: int = 2048) -> DataFrame:
    """Rows of both tasks from frames with movement labels: rows(split, gameid, step, observation_text, next_text and labels.PSEUDO).

    Steps without a label or a split give no rows and don't enter the history. ``metadata`` says where the label comes from.
    """
    labelled = rows.filter("split IS NOT NULL AND pseudo_action_id IS NOT NULL").withColumn("action_id", F.col("pseudo_action_id"))
    items = history.with_history(labelled, game="gameid", order=["step"], items=["observation_text", "action_id"])
    shown = history.for_mode(F.col("history"), mode, token_budget)
    metadata = F.struct(
        F.array(*[F.lit(int(i)) for i in valid_ids]).alias("valid_action_ids"),
        F.lit(labels.LABEL_SOURCE).alias("label_source"),
        F.lit(labels.LABEL_CONFIDENCE).alias("label_confidence"),
        F.lit(labels.LABEL_REASON).alias("label_reason"),
        *[F.col(c) for c in labels.PSEUDO if c != "pseudo_action_id"],
        F.lit(False).alias("true_keypress_label_available"),
    )
    made = {"policy_action": lambda: policy_row(items, dataset, mode, valid_ids, shown, metadata), "next_frame": lambda: frame_row(items.filter("next_text IS NOT NULL"), dataset, mode, shown, metadata)}
    return reduce(lambda a, b: a.unionByName(b), [made[t]() for t in tasks])


def limit_contract(max_rows: int | None, limits: dict[str, int] | None) -> None:
    """A build takes one limit over all rows or one for each split, all positive."""
    if max_rows is not None and limits is not None:
        raise ValueError("a build has max_rows or limits by split, not both")
    if max_rows is not None and max_rows <= 0:
        raise ValueError("max_rows must be positive")
    if limits is not None and (set(limits) != set(SPLITS) or min(limits.values()) <= 0):
        raise ValueError("each split needs a positive limit")


def limit_status(counts: DataFrame, limits: dict[str, int], tasks: Sequence[str] = TASKS) -> DataFrame:
    """counts(split, task, n) of acceptable rows against limits: row_limit, accepted, skipped, reached, and all_reached over all cells."""
    limit_contract(None, limits)
    grid = counts.sparkSession.createDataFrame([(s, t, limits[s]) for s in SPLITS for t in tasks], "split string, task string, row_limit int")
    n = F.coalesce("n", F.lit(0))
    told = grid.join(counts, ["split", "task"], "left").select(
        "split", "task", "row_limit", F.least(n, "row_limit").cast("long").alias("accepted"), F.greatest(F.lit(0), n - F.col("row_limit")).cast("long").alias("skipped"), (n >= F.col("row_limit")).alias("reached")
    )
    return told.crossJoin(F.broadcast(told.agg(F.bool_and("reached").alias("all_reached"))))


def required_limits(status: DataFrame) -> DataFrame:
    """The same rows; a job over them fails where a limit isn't reached."""
    return status.withColumn("reached", F.when(F.col("reached"), True).otherwise(F.raise_error(F.format_string("limit of %s %s not reached: %d of %d", "split", "task", "accepted", "row_limit"))))


def write_dataset(rows: DataFrame, path: str, *, dataset_name: str, mode: str, env_id: str, label_source: str, actions: Sequence[tuple[int, str]], rejections: DataFrame | None = None, limits: dict[str, int] | None = None, max_rows: int | None = None) -> None:
    """A dataset folder: rows by split and task, the split, action and rejection tables, sample rows and a manifest with counts."""
    limit_contract(max_rows, limits)
    spark = rows.sparkSession
    if max_rows is not None:
        rows = rows.orderBy("gameid", "step", "task").limit(max_rows)
    if limits is not None:
        number = F.row_number().over(W.partitionBy("split", "task").orderBy("gameid", "step"))
        wanted = F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), F.col("split"))
        rows = rows.withColumn("_k", number).filter(F.col("_k") <= max(limits.values())).filter(F.col("_k") <= wanted).drop("_k")
    rows.write.partitionBy("split", "task").json(f"{path}/rows")
    written = spark.read.schema(rows.schema).json(f"{path}/rows")
    written.select("split", "gameid").distinct().write.json(f"{path}/split_manifest")
    written.filter("split = 'train'").orderBy("gameid", "step", "task").limit(10).write.json(f"{path}/sample_rows")
    spark.createDataFrame([(env_id, k, i, n) for k, (i, n) in enumerate(actions)], "env_id string, ordinal int, action_id int, nle_action_name string").write.json(f"{path}/action_manifest")
    (spark.createDataFrame([], "reason string, count bigint") if rejections is None else rejections).write.json(f"{path}/rejection_report")
    counts = zero_filled(written.groupBy("split", "task").agg(F.count("*").alias("n")))
    manifest = counts.agg(F.collect_list(F.struct("split", "task", "n")).alias("accepted_rows_by_split"), F.sum("n").alias("accepted_rows")).select(
        F.lit(dataset_name).alias("dataset_name"), F.lit(mode).alias("mode"), F.lit(env_id).alias("env_id"), F.lit(label_source).alias("label_source"), "*"
    )
    manifest.write.json(f"{path}/manifest")


def zero_filled(counts: DataFrame) -> DataFrame:
    """counts(split, task, n) with a row for each of the 3 x 2 cells."""
    spark = counts.sparkSession
    grid = spark.createDataFrame([(s, t) for s in SPLITS for t in TASKS], "split string, task string")
    return grid.join(counts, ["split", "task"], "left").select("split", "task", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def merge_reasons(shards: Sequence[DataFrame]) -> DataFrame:
    """Sums per reason over shards' rejection reports."""
    return reduce(lambda a, b: a.unionByName(b), shards).groupBy("reason").agg(F.sum("count").alias("count"))


def merge_counts(shards: Sequence[DataFrame]) -> DataFrame:
    """Sums per split and task over shards; all shards count, not the first alone."""
    return reduce(lambda a, b: a.unionByName(b), shards).groupBy("split", "task").agg(F.sum("n").alias("n"))


def merge_splits(shards: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), shards).select("split", "gameid").distinct()


def mergeable(manifests: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Per key (or one row): whether dataset_name, mode, tasks, label_source and env_id agree over all shards' manifests."""
    identity = F.struct("dataset_name", "mode", "tasks", "label_source", "env_id")
    return manifests.groupBy(*key).agg((F.count_distinct(F.to_json(identity, {"ignoreNullFields": "false"})) <= 1).alias("mergeable"))


def interleaved(rows: DataFrame, per_task: int, *, order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """The first rows of each task, policy and next-frame rows in turn: (turn, task_rank) order."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy("task").orderBy(*order))).filter(F.col("_n") <= per_task)
    return ranked.withColumn("turn", F.col("_n") - 1).drop("_n").withColumn("task_rank", F.when(F.col("task") == "policy_action", 0).otherwise(1)).orderBy("turn", "task_rank")
