"""Reports over runs: readiness from markers and progress, the state of a goal, the best and the newest reports, shard records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Requirements whose failure means that live control failed.
LIVE_CONTROL = ("watch_current_action_repeat_rate_ceiling", "watch_current_zero_progress_episode_ceiling", "watch_current_score_or_depth_progress", "watch_action_repeat_rate", "watch_score_or_depth_progress")


def shard_records(names: DataFrame, *, source_root: str, shard_path: Column, status: str = "uploaded_shard") -> DataFrame:
    """A success record for each distinct name of a shard, as an upload ledger has them."""
    return names.select("name", shard_path.alias("shard_path")).distinct().select(
        "name", F.concat_ws("/", F.lit(source_root), "name").alias("source_path"), "shard_path", F.lit(status).alias("status"), F.lit(0).alias("returncode"), F.lit(0.0).alias("elapsed_seconds")
    )


def readiness(markers: DataFrame, key: Sequence[str] = ("run",)) -> DataFrame:
    """markers(run, name, required, present) -> per run: whether all required ones are there, and which are missing."""
    missing = F.sort_array(F.collect_list(F.when(F.col("required") & ~F.coalesce("present", F.lit(False)), F.col("name"))))
    return markers.groupBy(*key).agg(F.count("*").alias("marker_count"), missing.alias("missing_markers")).withColumn("ready", F.size("missing_markers") == 0)


def shard_summary(reports: DataFrame) -> DataFrame:
    """One row: reports that can be read, and the games and recordings in them."""
    number = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c).try_cast("long"), F.lit(0))), F.lit(0)).alias(c.replace("selected_", "").replace("count", "total"))
    return reports.agg(F.count("*").alias("report_count"), number("selected_game_count"), number("selected_ttyrec_count"))


def goal_state(gate_passed: Column, failed: Column, train_ready: Column, build_activity: Column, eval_ready: Column) -> Column:
    """Where a goal stands: the gate decides if there is one (NULL if not); before that the build, then the baseline's evaluation."""
    live = F.arrays_overlap(failed, F.array(*map(F.lit, LIVE_CONTROL)))
    return (
        F.when(gate_passed, "improvement_proved")
        .when(gate_passed.isNotNull() & F.coalesce(live, F.lit(False)), "rejected_live_control")
        .when(gate_passed.isNotNull(), "proof_failed")
        .when(~train_ready & (build_activity == "running"), "build_running")
        .when(~train_ready & (build_activity == "stalled"), "build_stalled")
        .when(~train_ready, "build_incomplete")
        .when(~eval_ready, "evaluation_incomplete")
        .otherwise("proof_missing")
    )


def build_activity(listed: Column, tasks: Column) -> Column:
    """running, stalled or unknown, from whether applications could be listed and how many tasks those of the build have (text)."""
    return F.when(~listed, "unknown").when(F.coalesce(F.trim(tasks).try_cast("int"), F.lit(0)) > 0, "running").otherwise("stalled")


def best_report(reports: DataFrame, *, run: str, value: str, prefix: str, key: Sequence[str]) -> DataFrame:
    """Per key the report with the greatest value (missing counts as 0), among those whose run has the prefix if any has; ties to the smallest run."""
    others = [c for c in reports.columns if c not in key]
    place = [F.col(run).startswith(prefix).alias("_p"), F.coalesce(F.col(value), F.lit(0.0)).alias("_v")]
    least = reports.groupBy(*key, *place).agg(F.min_by(F.struct(*others), run).alias("_r"))
    return least.groupBy(*key).agg(F.max_by("_r", F.struct("_p", "_v")).alias("_r")).select(*key, "_r.*")


#: Metrics of a rollout that a summary shows.
SHOWN = ("fitness_score", "cumulative_reward", "score_delta", "depth_delta", "wall_message_rate", "bad_message_rate", "action_repeat_rate", "non_advancing_step_rate", "menu_or_prompt_step_rate", "dirty_live_progress_event_count", "zero_progress_episode")


def compact(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys and those of the SHOWN metrics that there are."""
    return metrics.select(*keys, *[c for c in SHOWN if c in metrics.columns])


def dashboard(metrics: DataFrame, keys: Sequence[str], sides: Sequence[str] = ("current", "baseline")) -> DataFrame:
    """A row per key: the shown metrics of both sides as structs, and their differences where both are numbers."""
    shown = [c for c in SHOWN if c in metrics.columns]
    of = lambda s: F.max(F.when(F.col("side") == s, F.struct(*shown))).alias(s)
    both = compact(metrics, [*keys, "side"]).groupBy(*keys).agg(*map(of, sides))
    a, b = (F.col(s) for s in sides)
    return both.withColumn("deltas", F.struct(*[(a[c].cast("double") - b[c].cast("double")).alias(c) for c in shown]))


def newest(reports: DataFrame, limit: int, *, time: str, name: str) -> DataFrame:
    """The newest reports, ties to the greatest name."""
    return reports.orderBy(F.desc(time), F.desc(name)).limit(limit)


def space_failures(manifest: DataFrame, environment: DataFrame) -> DataFrame:
    """manifest(action_id, name) against environment(action_id, name): ids that either lacks, and names that differ."""
    m, e = manifest.select("action_id", F.col("name").alias("manifest_name")), environment.select("action_id", F.col("name").alias("environment_name"))
    joined = m.join(e, "action_id", "full_outer")
    failure = F.when(F.col("environment_name").isNull(), "missing_in_environment").when(F.col("manifest_name").isNull(), "missing_in_manifest").when(F.col("manifest_name") != F.col("environment_name"), "name_differs")
    return joined.withColumn("failure", failure).filter("failure IS NOT NULL").select("action_id", "manifest_name", "environment_name", "failure")


def failure_reports(attempts: DataFrame, key: Sequence[str] = ("run_id",)) -> DataFrame:
    """attempts(key, ordinal, stage, error_type, error_message, contract_path, mode, tracker) -> a report for each run with an error, of its first one.

    An attempt without error_type has gone well. A missing message is told as empty, and the tracker's own report is left out where it is missing or empty.
    """
    told = F.struct("stage", "error_type", F.coalesce("error_message", F.lit("")).alias("error_message"), "contract_path", "mode", F.nullif("tracker", F.lit("")).alias("tracker"))
    first = attempts.filter("error_type IS NOT NULL").groupBy(*key).agg(F.min_by(told, F.struct("ordinal", told)).alias("_f"))
    return first.select(*key, F.lit("failed").alias("status"), F.col("_f.stage").alias("failure_stage"), *[f"_f.{c}" for c in ("error_type", "error_message", "contract_path", "mode", "tracker")])
