"""Comparing runs: metrics side by side, requirements, external targets, means and spreads over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import depth_bucket, hash_bucket, missing_as, rate
from .splits import range_count, range_of

#: Metrics in which lower is better, beside those that end in _mae.
LOWER_IS_BETTER = ("next_frame_teacher_forced_mean_nll", "next_frame_teacher_forced_perplexity")


def direction(metric: Column) -> Column:
    counts = metric.endswith("_window_count") | metric.endswith("_frame_count")
    return F.when(counts, "higher_is_better").when(metric.isin(*LOWER_IS_BETTER) | metric.endswith("_mae"), "lower_is_better").otherwise("higher_is_better")


def compared(baseline: DataFrame, trained: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """metric, baseline, trained, delta (12 places), direction, improved, regressed for metrics(metric, value) that both runs have."""
    joined = baseline.select("metric", F.col("value").cast("double").alias("baseline")).join(trained.select("metric", F.col("value").cast("double").alias("trained")), "metric")
    if metrics is not None:
        joined = joined.filter(F.col("metric").isin(*metrics))
    delta = F.round(F.col("trained") - F.col("baseline"), 12)
    told = joined.withColumn("delta", delta).withColumn("direction", direction(F.col("metric")))
    gain = F.when(F.col("direction") == "lower_is_better", -F.col("delta")).otherwise(F.col("delta"))
    return told.withColumns({"improved": gain > 0, "regressed": gain < 0})


def verdict(improved: Column, regressed: Column, failures: Column | None = None) -> Column:
    """unproven, improved, regressed, mixed or unchanged from counts."""
    failed = F.lit(False) if failures is None else failures > 0
    return F.when(failed, "unproven").when((improved > 0) & (regressed == 0), "improved").when((regressed > 0) & (improved == 0), "regressed").when(improved + regressed > 0, "mixed").otherwise("unchanged")


def score_to_beat(comparison: DataFrame) -> DataFrame:
    """One row: how many metrics improved and regressed, and the verdict."""
    counted = comparison.agg(F.count("*").alias("metric_count"), F.count_if("improved").alias("improved_count"), F.count_if("regressed").alias("regressed_count"))
    return counted.withColumn("verdict", verdict(F.col("improved_count"), F.col("regressed_count")))


def requirements(wanted: DataFrame, comparison: DataFrame) -> DataFrame:
    """wanted(name, metric, mode) against a comparison: status passed, failed or missing.

    Modes: improved, not_regressed, positive_trained_value, above (trained > bound), at_most (trained <= bound) with a ``bound`` column.
    """
    bound = F.col("bound") if "bound" in wanted.columns else F.lit(None).cast("double")
    joined = wanted.join(comparison, "metric", "left")
    passed = (
        F.when(F.col("mode") == "improved", F.col("improved"))
        .when(F.col("mode") == "not_regressed", ~F.col("regressed"))
        .when(F.col("mode") == "positive_trained_value", F.col("trained") > 0)
        .when(F.col("mode") == "above", F.col("trained") > bound)
        .when(F.col("mode") == "at_most", F.col("trained") <= bound)
        .otherwise(F.raise_error(F.concat(F.lit("unknown requirement mode: "), F.coalesce("mode", F.lit("NULL")))))
    )
    return joined.select("name", "metric", "mode", F.when(F.col("trained").isNull(), "missing").when(passed, "passed").otherwise("failed").alias("status"))


def gate(rows: DataFrame) -> DataFrame:
    """One row: counts by status and the verdict: failed before missing before passed."""
    out = rows.agg(F.count("*").alias("requirement_count"), *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("passed", "failed", "missing")])
    return out.withColumn("verdict", F.when(F.col("failed_count") > 0, "failed").when(F.col("missing_count") > 0, "missing").otherwise("passed"))


def sequence_evidence(metrics: DataFrame, horizons: Sequence[int] = (1, 5, 10), suffixes: Sequence[str] = ("window_count", "frame_count")) -> DataFrame:
    """metrics(run, metric, value): what each run lacks as evidence per horizon: a metric that is missing or not positive."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame([(f"next_{h}_frame_sequence_{s}",) for h in horizons for s in suffixes], "metric string")
    full = metrics.select("run").distinct().crossJoin(F.broadcast(wanted)).join(metrics, ["run", "metric"], "left")
    return full.filter("value IS NULL OR value <= 0").select("run", "metric", F.when(F.col("value").isNull(), "missing").otherwise("empty").alias("failure"))


def registry_failures(registry: DataFrame) -> DataFrame:
    """benchmark_id, failure for entries that break the registry's rules; a declared set that differs fails as NULL id."""
    repeated = F.count("*").over(W.partitionBy("benchmark_id")) > 1
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = [
        ("duplicate_or_empty_id", F.col("_repeated") | blank("benchmark_id")),
        ("protocol_or_source_missing", blank("protocol_id") | blank("source")),
        ("required_reference_only", F.col("required_for_competitive") & (F.col("comparison") == "reference_only")),
        ("required_without_metric", F.col("required_for_competitive") & blank("candidate_metric")),
    ]
    told = registry.withColumn("_repeated", repeated).select("benchmark_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))).alias("failure"))
    sets = registry.agg(F.sort_array(F.collect_set(F.when(F.col("required_for_competitive"), F.col("benchmark_id")))).alias("derived"), F.first("declared").alias("declared"))
    differs = (F.size(F.array_except("derived", "declared")) > 0) | (F.size(F.array_except("declared", "derived")) > 0)
    return told.union(sets.filter(differs).select(F.lit(None).cast("string"), F.lit("declared_required_set_differs")))


def benchmark_comparison(registry: DataFrame, candidate: DataFrame, completed: Sequence[str]) -> DataFrame:
    """registry x candidate(metric, estimate, lower, upper): status, threshold and passed for each benchmark; only protocols that were run count."""
    joined = registry.join(candidate.withColumnRenamed("metric", "candidate_metric").withColumn("_has", F.lit(True)), "candidate_metric", "left")
    threshold = F.when(F.col("comparison") == "candidate_lower_at_least_target_lower", F.col("target.lower")).when(F.col("comparison") == "candidate_lower_at_least_target_estimate", F.col("target.estimate"))
    status = (
        F.when(F.col("comparison") == "reference_only", "reference_only")
        .when(~F.col("protocol_id").isin(*completed) if completed else F.lit(True), "protocol_not_run")
        .when(F.col("_has").isNull(), "candidate_metric_missing")
        .when(F.col("lower").isNull() | F.col("estimate").isNull(), "candidate_interval_missing")
        .when(F.col("lower") >= threshold, "passed")
        .otherwise("failed")
    )
    told = joined.withColumn("threshold", threshold).withColumn("status", status)
    return told.withColumn("passed", F.when(F.col("status") == "reference_only", F.lit(None).cast("boolean")).otherwise(F.col("status") == "passed")).select(
        "benchmark_id", "lane", "protocol_id", "required_for_competitive", "status", "threshold", "passed"
    )


def competitive(comparisons: DataFrame, internal_passed: bool) -> DataFrame:
    required = comparisons.filter("required_for_competitive")
    return required.agg((F.lit(internal_passed) & (F.count("*") > 0) & F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False))).alias("competitive"))


def spread(runs: DataFrame, group: Sequence[str] = ("metric",)) -> DataFrame:
    """Per metric over runs(run, metric, value): mean, sample deviation (0 for one run), least and greatest."""
    return runs.groupBy(*group).agg(F.count("*").alias("runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"), F.min("value").alias("min"), F.max("value").alias("max"))


def one_identity(reports: DataFrame, identity: Sequence[str]) -> DataFrame:
    """One row: whether all reports agree in each identity column."""
    return reports.agg(*[(F.countDistinct(c) == 1).alias(c) for c in identity])


def shuffled_pairs(rows: DataFrame, *, group: Sequence[str], key: str, label: str, seed: int) -> DataFrame:
    """Each row with the next row of its group, in hash order and around the end, that has another label: (columns, other key).

    A group is cut into ranges of the hash, one for each shuffle partition. Runs of equal labels are numbered within a range, and the row after a run's end is
    the partner of the whole run. The last run of a range takes its partner from the next range that holds another label: ranges, one row each, are gone
    through twice in order, from their last to their first. So no task sorts a group, and nothing is joined with all of it. A null is a label of its own.
    """
    w = W.partitionBy(*group, "_range").orderBy("_h", key)
    ranked = rows.withColumn("_h", hash_bucket(seed, F.col(key))).withColumn("_range", range_of(F.col("_h"), range_count(rows)))
    starts = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = ranked.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = runs.groupBy(*group, "_range", "_run").agg(F.min_by(F.struct(F.col(key).alias("other_key"), F.col(label).alias("other_label")), F.struct("_h", key)).alias("_first"), F.max(label).alias("_label"))
    first = first.withColumn("_next", F.lead("_first").over(W.partitionBy(*group, "_range").orderBy("_run")))
    ends = first.groupBy(*group, "_range").agg(
        F.min_by(F.struct(F.col("_first").alias("a"), F.col("_next").alias("b")), "_run").alias("_head"), F.max_by(F.struct("_run", "_label"), "_run").alias("_last")
    )
    laps = ends.withColumn("_lap", F.explode(F.array(F.lit(0), F.lit(1))))
    onward = W.partitionBy(*group).orderBy("_lap", "_range")
    # what a range offers to those before it: its first row, or its first one of another label, if either differs from the label before
    differs = ~F.col("_head.a.other_label").eqNullSafe(F.lag("_last").over(onward)["_label"])
    offered = laps.withColumn("_offer", F.when(differs, F.col("_head.a")).otherwise(F.col("_head.b")))
    back = W.partitionBy(*group).orderBy(F.desc("_lap"), F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    last = offered.withColumn("_next", F.last("_offer", ignorenulls=True).over(back)).filter("_lap = 0").select(*group, "_range", F.col("_last._run").alias("_run"), "_next")
    partners = first.filter("_next IS NOT NULL").select(*group, "_range", "_run", "_next").union(last.select(*group, "_range", "_run", "_next"))
    return runs.join(partners, [*group, "_range", "_run"]).filter("_next IS NOT NULL").select(*rows.columns, F.col("_next.other_key").alias("other_key"), F.col("_next.other_label").alias("other_label"))


def context_length(recorded: Column, user_text: Column) -> Column:
    """How many items of history a prompt shows: as recorded, else the actions it names."""
    return F.coalesce(recorded.cast("long"), F.regexp_count(user_text, F.lit("Previous action_id:")).cast("long"))


def matching_key(mode: Column, length: Column, role: Column, depth: Column) -> Column:
    """What rows have to agree in to be swapped with each other: mode, length of context, role and depth."""
    return F.struct(missing_as(mode, "unknown").alias("mode"), length.alias("context_length"), missing_as(role, "unknown").alias("role"), depth_bucket(depth).alias("depth"))


def sensitivity(cases: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row over cases(group, target, natural, shuffled predictions; shuffled NULL where a row has no partner): how far predictions depend on the current state."""
    used = F.col("shuffled").isNotNull()
    n = F.count_if(used)
    share = lambda test: F.round(rate(F.count_if(used & test), n), 6)
    key = F.struct(*group)
    out = cases.agg(
        F.count("*").alias("input_row_count"), n.alias("case_count"), F.countDistinct(key).alias("comparable_group_count"), F.countDistinct(F.when(used, key)).alias("used_group_count"),
        share(F.col("natural") == F.col("target")).alias("natural_exact_match_rate"), share(F.col("shuffled") == F.col("target")).alias("shuffled_exact_match_rate"), share(F.col("natural") != F.col("shuffled")).alias("prediction_change_rate"),
    )
    return out.withColumns({"skipped_group_count": F.col("comparable_group_count") - F.col("used_group_count"), "dependence_gap": F.round(F.col("natural_exact_match_rate") - F.col("shuffled_exact_match_rate"), 6)})


def flat_numbers(report: DataFrame) -> DataFrame:
    """path, value for every number and boolean of a one-row report, nested structs joined by slashes."""
    from pyspark.sql.types import BooleanType, NumericType, StructType

    found: list[tuple[str, Column]] = []

    def walk(schema: StructType, at: str, path: str) -> None:
        for f in schema.fields:
            here, name = f"{at}`{f.name}`", f"{path}{f.name}"
            if isinstance(f.dataType, StructType):
                walk(f.dataType, f"{here}.", f"{name}/")
            elif isinstance(f.dataType, (NumericType, BooleanType)):
                value = F.col(here).cast("int") if isinstance(f.dataType, BooleanType) else F.col(here)
                found.append((name, value.cast("double")))

    walk(report.schema, "", "")
    pairs = F.array(*[F.struct(F.lit(n).alias("path"), v.alias("value")) for n, v in found])
    return report.select(F.explode(pairs).alias("p")).select("p.*").filter("value IS NOT NULL")
