"""Histories: what a game did before a row, as bounded windows over arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import frames

#: Items that a history holds, and feedback lines that a prompt shows.
MAX_ITEMS = 16
MAX_FEEDBACK_LINES = 6
UNKNOWN = "<unknown>"


def with_history(rows: DataFrame, *, game: str, order: Sequence[str], items: Sequence[str], alias: str = "history") -> DataFrame:
    """rows with the last 16 items of their game before them, oldest first. Filter rows first: those filtered never enter."""
    w = W.partitionBy(game).orderBy(*order).rowsBetween(-MAX_ITEMS, -1)
    return rows.withColumn(alias, F.collect_list(F.struct(*items)).over(w))


def last_items(history: Column, count: int) -> Column:
    """The last ``count`` items; 0 means all, as an index of -0 does."""
    return history if count == 0 else F.slice(history, F.greatest(F.size(history) - count + 1, F.lit(1)), F.lit(count))


def longest_suffix(history: Column, item_length, budget: int) -> Column:
    """The longest suffix whose summed item length is within the budget."""
    suffixes = F.transform(history, lambda _, k: F.slice(history, k + 1, F.size(history)))
    fits = F.filter(suffixes, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + item_length(x).cast("int")) <= budget)
    return F.when(F.size(fits) > 0, fits[0]).otherwise(F.slice(history, 1, 0))


def for_mode(history: Column, mode: str, token_budget: int, *, text: str = "observation_text", action: str = "action_id", feedback: str = "feedback") -> Column:
    """The part of a history that a mode shows: none, the last N, or what fits in four characters per token; feedback modes drop missing feedback."""
    length = lambda x: F.length(x[text]) + F.length(x[action].cast("string"))
    # the values of a feedback struct, written out; a missing feedback adds nothing
    spoken = lambda x: F.coalesce(F.length(F.concat_ws("", x[feedback]["values"])), F.lit(0))
    if mode == "single_frame":
        return F.slice(history, 1, 0)
    if mode.startswith("context_"):
        return last_items(history, int(mode.removeprefix("context_")))
    if mode == "growing_context":
        return longest_suffix(history, length, 4 * token_budget)
    if mode.startswith("feedback_context_"):
        return F.filter(last_items(history, int(mode.removeprefix("feedback_context_"))), lambda x: x[feedback].isNotNull())
    if mode == "feedback_growing_context":
        return F.filter(longest_suffix(history, spoken, 4 * token_budget), lambda x: x[feedback].isNotNull())
    raise ValueError(f"unknown context mode: {mode}")


def feedback_text(feedback: Column) -> Column:
    """The last six feedback items as lines; '' for none. Items hold action_id, reward, cumulative_reward, hp, depth, game_time_advanced, message."""
    shown = last_items(feedback, MAX_FEEDBACK_LINES)
    value = lambda x, n: F.coalesce(x[n].cast("string"), F.lit("None"))
    line = lambda x: F.concat_ws(
        " ",
        F.concat(F.lit("- action_id="), value(x, "action_id")),
        F.concat(F.lit("reward="), value(x, "reward")),
        F.concat(F.lit("total="), value(x, "cumulative_reward")),
        F.concat(F.lit("hp="), value(x, "hp")),
        F.concat(F.lit("depth="), value(x, "depth")),
        F.concat(F.lit("advanced="), value(x, "game_time_advanced")),
        F.concat(F.lit("message="), F.regexp_replace(F.to_json(F.struct(F.coalesce(F.nullif(x["message"], F.lit("")), F.lit("<missing>")).alias("m"))), r'^\{"m":|\}$', "")),
    )
    return F.when(F.size(shown) > 0, F.concat_ws("\n", F.lit("Recent action feedback:"), F.array_join(F.transform(shown, line), "\n"))).otherwise("")


def outcome_feedback(action_id: Column, observation: Column) -> Column:
    """Feedback on an action from the observation after it, NULL without one; rewards and time are unknown to a replay."""
    unknown = F.lit(UNKNOWN)
    made = F.struct(
        action_id.alias("action_id"), unknown.alias("reward"), unknown.alias("cumulative_reward"), frames.message_text(observation).alias("message"),
        frames.blstat(observation, 10).alias("hp"), frames.blstat(observation, 12).alias("depth"), unknown.alias("game_time_advanced"),
    )
    return F.when(observation.isNotNull(), made)


def result_feedback(action_id: str = "action_id") -> Column:
    """Feedback on a step from its own result: rewards 0.0 and message '' where they are missing, time not advanced unless it says so."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.struct(
        F.col(action_id).cast("int").alias("action_id"), number("reward").alias("reward"), number("cumulative_reward").alias("cumulative_reward"), F.coalesce("message", F.lit("")).alias("message"),
        F.col("hp").alias("hp"), F.col("depth").alias("depth"), F.coalesce("game_time_advanced", F.lit(False)).alias("game_time_advanced"),
    )


def with_feedback(observation_text: Column, feedback: Column) -> Column:
    own = feedback_text(feedback)
    return F.when(own == "", observation_text).otherwise(F.concat(own, F.lit("\n\nCurrent rendered observation:\n"), observation_text))


def prompt(head: Column, observation_text: Column, history: Column, *, text: str = "observation_text", action: str = "action_id") -> Column:
    """head, the history's observations and actions, and the current observation."""
    items = F.transform(history, lambda x: F.concat(x[text], F.lit("\nPrevious action_id: "), x[action].cast("string")))
    past = F.when(F.size(history) > 0, F.concat(F.lit("Recent history:\n"), F.array_join(items, "\n"), F.lit("\n"))).otherwise("")
    return F.concat(head, F.lit("\n"), past, F.lit("Current observation:\n"), observation_text)
