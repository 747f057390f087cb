"""Rollouts: episode summaries, weighted fitness, differences between sides, preferences, similarity of action sequences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import events
from ..functions.scalars import action_text, difference, rate, signed_log1p

#: Fixed values of the fitness objective.
OBJECTIVE_VERSION = "live_rollout_utility_v7"
WEIGHTS = {
    "normalized_score_delta": 1.0,
    "cumulative_reward": 0.25,
    "depth_delta": 3.0,
    "visible_map_novelty": 0.0,
    "meaningful_event": 0.10,
    "live_progress_event": 0.50,
    "hp_damage": -0.50,
    "death": -8.0,
    "starvation_or_faint": -1.50,
    "wall_or_solid_stone_message": -0.10,
    "wall_message_rate": -2.50,
    "bad_message": -0.10,
    "bad_message_rate": -1.50,
    "non_advancing_step": -0.20,
    "non_advancing_step_rate": -1.00,
    "action_collapse_excess": -0.05,
    "action_collapse_rate_excess": -2.00,
    "menu_or_prompt_step_rate": -1.50,
    "stuck_menu_or_prompt_loop": -0.50,
    "dirty_live_progress_event": -1.00,
    "zero_progress_episode": -3.00,
}
COLLAPSE_RATE = 0.50
MAX_BONUS_COUNT = 5
MIN_UTILITY_MARGIN = 0.05
EPISODE = ("run_id", "seed", "side")

#: Which summary column each weight applies to, in the order of the weights; signed logarithms for scores.
TERMS = {
    "normalized_score_delta": lambda: signed_log1p(F.col("score_delta_for_fitness")),
    "cumulative_reward": lambda: signed_log1p(F.col("cumulative_reward")),
    "depth_delta": lambda: F.col("depth_delta"),
    "visible_map_novelty": lambda: F.least(F.col("visible_map_novelty_count"), F.lit(MAX_BONUS_COUNT)),
    "meaningful_event": lambda: F.least(F.col("meaningful_event_count"), F.lit(MAX_BONUS_COUNT)),
    "live_progress_event": lambda: F.col("live_progress_event_count"),
    "hp_damage": lambda: F.coalesce("hp_damage_observed", F.lit(0)),
    "death": lambda: F.when(F.coalesce("death", F.lit("")) != "", 1).otherwise(0),
    "starvation_or_faint": lambda: F.col("starvation_or_faint_count"),
    "wall_or_solid_stone_message": lambda: F.col("wall_message_count"),
    "wall_message_rate": lambda: F.col("wall_message_rate"),
    "bad_message": lambda: F.col("bad_message_count"),
    "bad_message_rate": lambda: F.col("bad_message_rate"),
    "non_advancing_step": lambda: F.col("non_advancing_step_count"),
    "non_advancing_step_rate": lambda: F.col("non_advancing_step_rate"),
    "action_collapse_excess": lambda: F.col("action_collapse_excess"),
    "action_collapse_rate_excess": lambda: F.col("action_collapse_rate_excess"),
    "menu_or_prompt_step_rate": lambda: F.col("menu_or_prompt_step_rate"),
    "stuck_menu_or_prompt_loop": lambda: F.col("stuck_menu_or_prompt_loop_count"),
    "dirty_live_progress_event": lambda: F.col("dirty_live_progress_event_count"),
    "zero_progress_episode": lambda: F.col("zero_progress_episode"),
}


def paired_sides(current: DataFrame, baseline: DataFrame, *, key: Sequence[str] = ("run_id", "seed", "step")) -> DataFrame:
    """Steps of two rollouts side by side: a struct for each side, NULL where it took no such step, and whether both did and acted alike."""
    side = lambda rows, name: rows.select(*key, F.struct(*[c for c in rows.columns if c not in key]).alias(name))
    joined = side(current, "current").join(side(baseline, "baseline"), list(key), "full_outer")
    return joined.withColumn("same_action", F.coalesce(F.col("current.action_id") == F.col("baseline.action_id"), F.lit(False)))


def long_events(reports: DataFrame, sides: Sequence[str] = ("current", "baseline")) -> DataFrame:
    """reports(run_id, seed, events: array<struct<step, current, baseline>>) -> a row per step and side that took part, the side's fields as columns."""
    steps = reports.select("run_id", "seed", F.explode("events").alias("e"))
    both = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"e.{s}").alias("v")) for s in sides])
    return steps.select("run_id", "seed", F.col("e.step").alias("step"), F.explode(both).alias("x")).filter("x.v IS NOT NULL").select("run_id", "seed", "step", "x.side", "x.v.*")


def progress_flags(rows: DataFrame, *, episode: Sequence[str], order: str, dirty: Column) -> DataFrame:
    """rows with raw, clean and dirty progress: reward, or score or depth above the last known one. Rows without an action don't count and aren't remembered."""
    w = W.partitionBy(*episode).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    acted = F.col("action_id").isNotNull()
    known = lambda c: F.last(F.when(acted, F.col(c)), ignorenulls=True).over(w)
    start = lambda c: F.col(f"initial_{c}") if f"initial_{c}" in rows.columns else F.lit(None).cast("int")
    rose = lambda c: F.coalesce(F.col(c) > F.coalesce(known(c), start(c)), F.lit(False))
    told = rows.withColumn("raw_progress", acted & ((F.coalesce("reward", F.lit(0.0)) > 0) | rose("score") | rose("depth"))).withColumn("_dirty", dirty)
    return told.withColumns({"clean_progress": F.col("raw_progress") & ~F.col("_dirty"), "dirty_progress": F.col("raw_progress") & F.col("_dirty")}).drop("_dirty")


def stuck_loops(rows: DataFrame, *, episode: Sequence[str], order: str, prompt: Column, signature: Column) -> DataFrame:
    """rows with ``stuck``: a prompt right after a prompt with the same action and message."""
    w = W.partitionBy(*episode).orderBy(order)
    told = rows.withColumn("_p", prompt).withColumn("_s", signature)
    same = F.col("_p") & F.coalesce(F.lag("_p").over(w), F.lit(False)) & F.lag("_s").over(w).eqNullSafe(F.col("_s"))
    return told.withColumn("stuck", same).drop("_p", "_s")


def novelty(rows: DataFrame, *, episode: Sequence[str], frame: str = "terminal_frame") -> DataFrame:
    """Per episode, how many distinct tiles its frames show beyond those of ``initial_frame``, if there is one."""
    tiles = rows.select(*episode, F.explode(events.map_tiles(F.col(frame))).alias("tile")).distinct()
    if "initial_frame" in rows.columns:
        seen = rows.select(*episode, F.explode(events.map_tiles(F.col("initial_frame"))).alias("tile")).distinct()
        tiles = tiles.join(seen, [*episode, "tile"], "left_anti")
    return tiles.groupBy(*episode).agg(F.count("*").alias("visible_map_novelty_count"))


def summaries(rows: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """One row per episode: counts, rates, first, last and extreme values; then fitness components and score.

    Rates divide by steps with an action, while their counts are over all events, so they can exceed 1. Death is that of the last event.
    """
    told = progress_flags(rows, episode=episode, order="step", dirty=events.is_dirty())
    signature = F.struct("action_id", F.lower(F.coalesce("message", F.lit(""))).alias("m"))
    told = stuck_loops(told, episode=episode, order="step", prompt=events.is_prompt(), signature=signature)
    known = lambda f, c: f(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("step")))
    start = lambda c: F.coalesce(F.max(f"initial_{c}"), known(F.min_by, c)) if f"initial_{c}" in rows.columns else known(F.min_by, c)
    initial_hp = F.max("initial_hp") if "initial_hp" in rows.columns else F.lit(None).cast("int")
    acted = F.col("action_id").isNotNull()
    actions = told.filter(acted).groupBy(*episode, "action_id").agg(F.count("*").alias("_n")).groupBy(*episode).agg(F.max("_n").alias("action_mode_count"))
    base = told.groupBy(*episode).agg(
        F.count("*").alias("event_count"),
        F.count_if(acted).alias("step_count"),
        F.coalesce(F.max_by("cumulative_reward", "step"), F.lit(0.0)).alias("cumulative_reward"),
        start("score").alias("score_initial"),
        known(F.max_by, "score").alias("score_final"),
        F.coalesce(F.max_by("done", "step"), F.lit(False)).alias("done"),
        F.max_by("death", "step").alias("death"),
        initial_hp.alias("hp_initial"),
        known(F.max_by, "hp").alias("hp_final"),
        F.min("hp").alias("hp_min"),
        start("depth").alias("depth_initial"),
        F.max("depth").alias("depth_max"),
        F.count_if(events.is_wall()).alias("wall_message_count"),
        F.count_if(events.is_bad()).alias("bad_message_count"),
        F.count_if(acted & events.stands_still()).alias("non_advancing_step_count"),
        F.count_if(events.is_hunger_warning()).alias("hunger_warning_count"),
        F.count_if(events.is_starving()).alias("starvation_or_faint_count"),
        F.count_if(events.is_prompt()).alias("menu_or_prompt_step_count"),
        F.count_if("stuck").alias("stuck_menu_or_prompt_loop_count"),
        F.count_if("raw_progress").alias("raw_live_progress_event_count"),
        F.count_if("clean_progress").alias("live_progress_event_count"),
        F.count_if("dirty_progress").alias("dirty_live_progress_event_count"),
        F.count_if("clean_progress").alias("meaningful_event_count"),
    )
    joined = base.join(actions, list(episode), "left").join(novelty(told, episode=episode), list(episode), "left")
    filled = joined.fillna(0, ["action_mode_count", "visible_map_novelty_count"])
    steps = F.col("step_count")
    derived = filled.withColumns(
        {
            "score_delta": F.col("score_final") - F.col("score_initial"),
            "hp_damage_observed": F.greatest(F.lit(0), F.col("hp_initial") - F.col("hp_min")) + F.when(F.col("hp_initial").isNull() | F.col("hp_min").isNull(), F.lit(None).cast("int")).otherwise(0),
            "depth_delta": F.coalesce(F.greatest(F.lit(0), F.col("depth_max") - F.col("depth_initial")), F.lit(0)),
            "action_repeat_rate": rate(F.col("action_mode_count"), steps),
            "action_collapse_excess": F.greatest(F.lit(0), F.col("action_mode_count") - F.when(steps > 0, F.greatest(F.lit(1), F.floor(steps * 0.75))).otherwise(0)),
            **{f"{n}_rate": rate(F.col(c), steps) for n, c in (("wall_message", "wall_message_count"), ("bad_message", "bad_message_count"), ("non_advancing_step", "non_advancing_step_count"), ("menu_or_prompt_step", "menu_or_prompt_step_count"))},
        }
    )
    derived = derived.withColumns(
        {"action_collapse_rate_excess": F.greatest(F.lit(0.0), F.col("action_repeat_rate") - COLLAPSE_RATE), "score_delta_for_fitness": F.coalesce(F.col("score_delta").cast("double"), F.col("cumulative_reward"))}
    )
    still = (steps > 0) & (F.col("cumulative_reward") <= 0) & (F.col("score_delta_for_fitness") <= 0) & (F.col("depth_delta") <= 0) & (F.col("raw_live_progress_event_count") == 0)
    return with_fitness(derived.withColumn("zero_progress_episode", still.cast("int")))


def with_fitness(summary: DataFrame, terms: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """summary with ``fitness_components`` (struct, one weighted term each) and ``fitness_score``, their sum."""
    parts = {t: F.lit(WEIGHTS[t]) * TERMS[t]().cast("double") for t in terms}
    return summary.withColumn("fitness_components", F.struct(*[v.alias(k) for k, v in parts.items()])).withColumn("fitness_score", reduce(lambda a, b: a + b, (F.col(f"fitness_components.{t}") for t in terms)))


def side_deltas(summary: DataFrame, metrics: Sequence[str], *, key: Sequence[str] = ("run_id", "seed"), side: str = "side") -> DataFrame:
    """current - baseline of each metric per key; 0.0 where either lacks it. Keys need both sides."""
    sides = [summary.filter(F.col(side) == s).select(*key, *[F.col(m).alias(f"{m}_{s}") for m in metrics]) for s in ("current", "baseline")]
    return sides[0].join(sides[1], list(key)).select(*key, *[difference(F.col(f"{m}_current"), F.col(f"{m}_baseline")).alias(m) for m in metrics])


def sweep_means(summary: DataFrame, metrics: Sequence[str], group: Sequence[str] = ("run_id", "side")) -> DataFrame:
    """Means over seeds; seeds without a metric are left out of it."""
    return summary.groupBy(*group).agg(F.count("*").alias("seed_count"), *[F.avg(m).alias(m) for m in metrics])


def sequence_similarity(sequences: DataFrame, *, key: str, actions: str) -> DataFrame:
    """One row: over all unordered pairs of sequences, the share that are equal and the mean share of equal places (of the longer length).

    For sequences that come as arrays; ``step_similarity`` takes them as rows.
    """
    own = sequences.select(F.col(actions).alias("a"), F.size(actions).alias("n"))
    placed = own.select("n", F.posexplode("a").alias("at", "x"))
    return _similarity(own.groupBy("n", "a").agg(F.count("*").alias("c")), placed)


def step_similarity(steps: DataFrame, *, key: str, place: str, action: str) -> DataFrame:
    """sequence_similarity of sequences that come as rows (key, place, action), each place once: no sequence is gathered, however long.

    Equal sequences are told by their length and 128 bits of hashes of their places and actions, which add up in any order (by exclusive or).
    """
    own = steps.select(F.col(key).alias("k"), F.col(place).alias("at"), F.col(action).alias("x"))
    told = own.groupBy("k").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(salt), "at", "x")).alias(f"h{salt}") for salt in (1, 2)])
    return _similarity(told.groupBy("n", "h1", "h2").agg(F.count("*").alias("c")), own.join(told.select("k", "n"), "k"))


def _similarity(classes: DataFrame, steps: DataFrame) -> DataFrame:
    """One row from classes(n, c) of equal sequences of length n and all steps(n, at, x).

    The equal share comes from counts of whole sequences, and the place share, for sequences of one length, from counts of actions per place: no
    pair is formed. Sequences of different lengths meet only as counts per (place, action, length), summed up over the shorter ones.
    """
    twos = lambda c: c * (c - 1) / 2
    one_row = classes.agg(twos(F.sum("c")).alias("pairs"), F.sum(twos(F.col("c"))).alias("equal_pairs"), F.coalesce(F.sum(F.when(F.col("n") == 0, twos(F.col("c")))), F.lit(0.0)).alias("empty_pairs"))
    placed = steps.filter("x IS NOT NULL").groupBy("at", "x", "n").agg(F.count("*").alias("c"))
    shorter = F.coalesce(F.sum("c").over(W.partitionBy("at", "x").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = placed.select("n", (F.col("c") * shorter + F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))
    places = met.agg(F.sum(F.col("pairs") / F.col("n")).alias("same"))
    # two empty sequences are equal in full
    return one_row.crossJoin(places).select(
        F.coalesce("pairs", F.lit(0)).cast("long").alias("pair_count"),
        F.coalesce("equal_pairs", F.lit(0)).cast("long").alias("equal_pairs"),
        F.round(rate(F.col("equal_pairs"), F.col("pairs")), 6).alias("identity_rate"),
        F.round(rate(F.coalesce("same", F.lit(0.0)) + F.col("empty_pairs"), F.col("pairs")), 6).alias("mean_similarity"),
    )


# Preferences between the two sides of one step


def utility(prefix: str) -> Column:
    """struct<value, positive, bad> of one side's outcome; columns are prefix + name."""
    c = lambda name: F.col(f"{prefix}{name}")
    score, depth = difference(c("score"), c("prompt_score")), F.greatest(F.lit(0.0), difference(c("depth"), c("prompt_depth")))
    damage = F.greatest(F.lit(0.0), -difference(c("hp"), c("prompt_hp")))
    reward = F.coalesce(c("reward"), F.lit(0.0))
    flag = lambda x: x.cast("double")
    acted = c("action_id").isNotNull()
    wall, bad, prompt = events.is_wall(prefix), events.is_bad(prefix), events.is_prompt(prefix)
    still, starving, died = events.stands_still(prefix) & acted, events.is_starving(prefix), events.has_died(prefix)
    raw = (reward > 0) | (score > 0) | (depth > 0)
    dirty = raw & (wall | bad | still | prompt | died)
    meaningful = acted & raw & ~(wall | bad | still | prompt)
    before = F.coalesce(F.nullif(c("prompt_terminal_frame"), F.lit("")), c("policy_observation_text"))
    new_tiles = F.when(before.isNotNull() & c("terminal_frame").isNotNull(), F.size(F.array_except(events.map_tiles(c("terminal_frame")), events.map_tiles(before)))).otherwise(0)
    parts = {
        "normalized_score_delta": signed_log1p(score),
        "cumulative_reward": signed_log1p(reward),
        "depth_delta": depth,
        "visible_map_novelty": F.least(new_tiles, F.lit(MAX_BONUS_COUNT)).cast("double"),
        "meaningful_event": flag(meaningful),
        "live_progress_event": flag(raw & ~dirty),
        "hp_damage": damage,
        "wall_or_solid_stone_message": flag(wall),
        "wall_message_rate": flag(wall),
        "bad_message": flag(bad),
        "bad_message_rate": flag(bad),
        "non_advancing_step": flag(still),
        "non_advancing_step_rate": flag(still),
        "menu_or_prompt_step_rate": flag(prompt),
        "starvation_or_faint": flag(starving),
        "stuck_menu_or_prompt_loop": flag(prompt),
        "dirty_live_progress_event": flag(dirty),
        "zero_progress_episode": flag(~raw),
        "death": flag(died),
    }
    value = reduce(lambda a, b: a + b, (F.lit(WEIGHTS[k]) * v for k, v in parts.items()))
    return F.struct(value.alias("value"), (raw & ~dirty).alias("positive"), ((damage > 0) | wall | bad | still | starving | prompt | died).alias("bad"))


def choose(rows: DataFrame, current: str, baseline: str, *, current_action: str, baseline_action: str, current_prompt: str, baseline_prompt: str) -> DataFrame:
    """rows with utilities (structs) in two columns -> skip_reason, chosen_side, chosen_action, rejected_action, utility_margin."""
    a, b = F.col(current), F.col(baseline)
    ahead = a["value"] > b["value"]
    good, poor = F.when(ahead, a).otherwise(b), F.when(ahead, b).otherwise(a)
    quality = good["positive"] | (poor["bad"] & ~good["bad"])
    skip = (
        F.when(F.col(current_action).isNull() | F.col(baseline_action).isNull(), "missing_action")
        .when(F.col(current_action) == F.col(baseline_action), "same_action")
        .when(F.col(current_prompt).isNull() | F.col(baseline_prompt).isNull(), "missing_prompt")
        .when(F.col(current_prompt) != F.col(baseline_prompt), "divergent_prompt")
        .when(F.abs(a["value"] - b["value"]) < MIN_UTILITY_MARGIN, "utility_tie")
        .when(~quality, "low_quality_preference")
    )
    side = lambda x, y: F.when(ahead, x).otherwise(y)
    return rows.withColumn("skip_reason", skip).withColumns(
        {
            "chosen_side": F.when(F.col("skip_reason").isNull(), side(F.lit("current"), F.lit("baseline"))),
            "chosen_action": F.when(F.col("skip_reason").isNull(), side(F.col(current_action), F.col(baseline_action))),
            "rejected_action": F.when(F.col("skip_reason").isNull(), side(F.col(baseline_action), F.col(current_action))),
            "utility_margin": F.when(F.col("skip_reason").isNull(), F.abs(a["value"] - b["value"])),
        }
    )


def preferences(watch: DataFrame) -> DataFrame:
    """Watch events in long form -> one row per step of both sides: skip_reason, or the chosen and rejected answers to the shared prompt."""
    side = lambda s: watch.filter(F.col("side") == s).select("run_id", "seed", "step", *[F.col(c).alias(f"{s}_{c}") for c in watch.columns if c not in ("run_id", "seed", "step", "side")])
    both = side("current").join(side("baseline"), ["run_id", "seed", "step"])
    told = both.withColumns({"current": utility("current_"), "baseline": utility("baseline_"), "current_prompt_text": F.nullif(F.col("current_policy_user_prompt"), F.lit("")), "baseline_prompt_text": F.nullif(F.col("baseline_policy_user_prompt"), F.lit(""))})
    chosen = choose(told, "current", "baseline", current_action="current_action_id", baseline_action="baseline_action_id", current_prompt="current_prompt_text", baseline_prompt="baseline_prompt_text")
    return chosen.select(
        "run_id", "seed", "step", "skip_reason", "chosen_side", F.col("current_prompt_text").alias("prompt"), action_text(F.col("chosen_action")).alias("chosen"), action_text(F.col("rejected_action")).alias("rejected"), "utility_margin"
    )
