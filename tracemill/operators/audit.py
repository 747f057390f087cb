"""Dataset integrity: every predicate a named failure, counted in one pass, with a few examples each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import frames
from ..functions.scalars import rate_or_null

IDENTITY = ("episode_id", "step", "sequence_id", "sequence_step")


def well_formed(messages: Column) -> Column:
    """Exactly system, user and assistant, all with content."""
    roles = F.transform(messages, lambda m: m["role"])
    return F.coalesce((roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & F.forall(messages, lambda m: m["content"].isNotNull()), F.lit(False))


def assistant_action(text: Column) -> Column:
    """The action of {"action_id": n} alone, n an integer and no boolean; else NULL."""
    value = F.get_json_object(text, "$.action_id")
    only = F.json_object_keys(text) == F.array(F.lit("action_id"))
    return F.when(only & value.rlike(r"^-?\d+$") & ~text.rlike(r'"action_id"\s*:\s*"'), value.try_cast("int"))


def failures(rows: DataFrame, *, valid_ids: Sequence[int], keys: DataFrame, split_games: DataFrame) -> DataFrame:
    """rows(split_dir, task_dir, SUPERVISED_ROW columns, _corrupt_record) with ``failures`` (array of reasons), ``label`` and ``changed``.

    keys is a key map (raw_key_code, n_actions, action_id), split_games(split, gameid) the split manifest.
    """
    ids = F.array(*[F.lit(int(i)) for i in valid_ids])
    mapped = keys.select(F.col("raw_key_code").alias("_key"), F.col("n_actions").alias("_n"), F.col("action_id").alias("_mapped"))
    assigned = split_games.select(F.col("split").alias("_split"), F.col("gameid").alias("_gameid"), F.lit(True).alias("_assigned")).distinct()
    joined = rows.join(mapped, rows["metadata"]["raw_key_code"] == mapped["_key"], "left").join(assigned, (F.col("split_dir") == F.col("_split")) & (F.col("gameid") == F.col("_gameid")), "left")
    repeat = F.row_number().over(W.partitionBy("task_dir", *IDENTITY).orderBy("ordinal")) > 1
    parsed = F.col("_corrupt_record").isNull()
    judged = joined.withColumns({"_repeat": repeat, "_messages_ok": well_formed(F.col("messages"))})

    user, assistant = frames.last_content(F.col("messages"), "user"), frames.last_content(F.col("messages"), "assistant")
    target, said, conditioning = F.col("metadata.target_action_id"), assistant_action(assistant), F.col("metadata.conditioning_action_id")
    only_mapped = F.when(F.col("_n") == 1, F.col("_mapped"))
    has_metadata = F.col("metadata").isNotNull()
    has_label = parsed & has_metadata & F.col("_messages_ok")
    policy = has_label & (F.col("task_dir") == "policy_action")
    frame = has_label & (F.col("task_dir") == "next_frame")
    readable = target.isNotNull() & said.isNotNull()
    sections = F.forall(F.array(*[F.lit(s) for s in frames.SECTIONS]), lambda s: F.contains(assistant, s))
    prefix = F.concat(F.lit('Action taken: {"action_id": '), conditioning.cast("string"), F.lit("}\n"))
    checks = [
        ("malformed_json_row", ~parsed),
        ("row_split_mismatch", parsed & ~F.col("split").eqNullSafe(F.col("split_dir"))),
        ("row_task_mismatch", parsed & ~F.col("task").eqNullSafe(F.col("task_dir"))),
        ("row_gameid_invalid", parsed & F.col("gameid").isNull()),
        ("row_game_missing_from_split_manifest", parsed & F.col("gameid").isNotNull() & F.col("_assigned").isNull()),
        ("row_episode_id_invalid", parsed & (F.coalesce("episode_id", F.lit("")) == "")),
        ("duplicate_task_row_identity", parsed & F.col("_repeat")),
        ("row_metadata_invalid", parsed & ~has_metadata),
        ("row_valid_action_ids_mismatch", parsed & has_metadata & ~F.col("metadata.valid_action_ids").eqNullSafe(ids)),
        ("row_raw_key_code_missing", parsed & has_metadata & F.col("metadata.raw_key_code").isNull()),
        ("row_raw_key_unmapped", parsed & F.col("metadata.raw_key_code").isNotNull() & F.col("_n").isNull()),
        ("row_raw_key_ambiguous", parsed & (F.col("_n") > 1)),
        ("row_messages_invalid", parsed & has_metadata & ~F.col("_messages_ok")),
        ("policy_action_json_invalid", policy & ~readable),
        ("policy_target_out_of_space", policy & readable & ~F.array_contains(ids, target)),
        ("policy_assistant_target_mismatch", policy & readable & (said != target)),
        ("policy_raw_key_target_mismatch", policy & readable & (only_mapped != target)),
        ("next_frame_conditioning_action_missing", frame & conditioning.isNull()),
        ("next_frame_action_out_of_space", frame & conditioning.isNotNull() & ~F.array_contains(ids, conditioning)),
        ("next_frame_raw_key_action_mismatch", frame & (only_mapped != conditioning)),
        ("next_frame_prompt_action_mismatch", frame & conditioning.isNotNull() & ~F.coalesce(user.startswith(prefix), F.lit(False))),
        ("next_frame_target_shape_invalid", frame & conditioning.isNotNull() & ~F.coalesce(sections, F.lit(False))),
    ]
    marker = "\nCurrent observation:\n"
    return judged.withColumns(
        {
            "failures": F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks])),
            "label": F.when(policy, target).when(frame, conditioning),
            "changed": F.when(frame & conditioning.isNotNull() & F.contains(user, F.lit(marker)), F.substring_index(user, marker, -1) != assistant),
        }
    ).drop("_key", "_n", "_mapped", "_split", "_gameid", "_assigned", "_repeat", "_messages_ok")


def failure_report(judged: DataFrame, examples: int = 5) -> DataFrame:
    """reason, count, and the ordinals of the first rows of each."""
    told = judged.select("ordinal", F.explode("failures").alias("reason"))
    ranked = told.withColumn("_k", F.row_number().over(W.partitionBy("reason").orderBy("ordinal")))
    return ranked.groupBy("reason").agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.when(F.col("_k") <= examples, F.col("ordinal")))).alias("examples"))


def paired(policy: DataFrame, frame: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """One row: identities of both tasks, of either alone, and pairs whose labels differ; identities compare null-safely, the last row of one wins."""
    last = lambda rows, name: rows.groupBy(*identity).agg(F.max_by("label", "ordinal").alias(name), F.lit(True).alias(f"has_{name}"))
    a, b = last(policy, "policy").alias("a"), last(frame, "frame").alias("b")
    condition = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in identity]
    both = F.col("has_policy").isNotNull() & F.col("has_frame").isNotNull()
    return a.join(b, condition, "full_outer").agg(
        F.count_if(both).alias("paired"),
        F.count_if(F.col("has_frame").isNull()).alias("policy_only"),
        F.count_if(F.col("has_policy").isNull()).alias("frame_only"),
        F.count_if(both & ~F.col("policy").eqNullSafe(F.col("frame"))).alias("mismatched"),
    )


def duplicate_identities(rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    return rows.groupBy(*identity).agg(F.count("*").alias("copies")).filter("copies > 1")


def action_distribution(rows: DataFrame, group: Sequence[str], action: str) -> DataFrame:
    """Per group: total, distinct actions, the dominant one (ties: the smallest), its share, and the histogram by falling count as text."""
    counts = rows.groupBy(*group, action).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(action).alias("a"))))
    return counts.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("unique_action_count"), ordered.alias("_h")).select(
        *group,
        "total",
        "unique_action_count",
        F.col("_h")[0]["a"].alias("dominant_action"),
        (-F.col("_h")[0]["m"]).alias("dominant_count"),
        F.round(rate_or_null(-F.col("_h")[0]["m"], F.col("total")), 6).alias("dominant_rate"),
        F.array_join(F.transform("_h", lambda x: F.concat_ws(":", x["a"].cast("string"), (-x["m"]).cast("string"))), ",").alias("histogram"),
    )


def coverage_gaps(rows: DataFrame, value: str, base: str = "train", held_out: Sequence[str] = ("validation", "test")) -> DataFrame:
    """Values of the base split that a held-out split lacks: (split, value)."""
    sets = rows.groupBy(value).agg(F.collect_set("split").alias("s")).filter(F.array_contains("s", base))
    return sets.select(F.explode(F.array_except(F.array(*[F.lit(x) for x in held_out]), "s")).alias("split"), value)


def reconciliation(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """expected and actual counts side by side, with whether they agree."""
    joined = expected.select(*keys, F.col("n").alias("expected")).join(actual.select(*keys, F.col("n").alias("actual")), list(keys), "full_outer")
    filled = joined.select(*keys, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return filled.withColumn("agrees", F.col("expected") == F.col("actual"))
