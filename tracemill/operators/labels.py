"""Movement labels from visible frames, and their audit against true keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import let, missing_as, rate

#: The player's glyph, and the direction of a move by (rows, columns).
PLAYER_GLYPH = 64
DIRECTIONS = {"N": (-1, 0), "NE": (-1, 1), "E": (0, 1), "SE": (1, 1), "S": (1, 0), "SW": (1, -1), "W": (0, -1), "NW": (-1, -1)}


#: What a label of visible movement says about itself, and its columns.
LABEL_SOURCE, LABEL_REASON, LABEL_CONFIDENCE = "pseudo_visible_player_delta", "single_visible_player_moved_one_cell", 1.0
PSEUDO = ("pseudo_direction", "pseudo_action_id", "pseudo_action_name", "pseudo_key_label")


def player_place(grid: Column) -> Column:
    """struct<row, col> of the player if the grid shows exactly one, else NULL."""
    places = F.flatten(
        F.transform(grid, lambda line, r: F.transform(F.filter(F.transform(line, lambda x, c: F.when(x == PLAYER_GLYPH, c)), lambda c: c.isNotNull()), lambda c: F.struct(r.alias("row"), c.alias("col"))))
    )
    return let(places, lambda p: F.when(F.size(p) == 1, p[0]))


def direction(before: Column, after: Column) -> Column:
    """Compass direction of a move by one cell, else NULL."""
    rows, cols = after["row"] - before["row"], after["col"] - before["col"]
    out = F.lit(None).cast("string")
    for name, (r, c) in DIRECTIONS.items():
        out = F.when((rows == r) & (cols == c), name).otherwise(out)
    return out


def with_movement_labels(rows: DataFrame, actions: DataFrame, current: str = "observation.tty_chars", following: str = "next_observation.tty_chars") -> DataFrame:
    """rows with pseudo_direction, pseudo_action_id, pseudo_action_name, pseudo_key_label; NULL where no label can be told."""
    by_name = actions.filter(F.col("nle_action_name").startswith("CompassDirection.")).groupBy(F.substring_index("nle_action_name", ".", -1).alias("_d"))
    moves = by_name.agg(F.min_by(F.struct(F.col("action_id").alias("a"), F.col("nle_action_name").alias("n"), F.col("key_label").alias("k")), "ordinal").alias("_m"))
    places = rows.withColumns({"_from": player_place(F.col(current)), "_to": player_place(F.col(following))})
    told = places.withColumn("_dir", direction(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    joined = told.join(moves, F.col("_dir") == F.col("_d"), "left")
    return joined.withColumns(
        {"pseudo_direction": F.when(F.col("_m").isNotNull(), F.col("_dir")), "pseudo_action_id": F.col("_m.a"), "pseudo_action_name": F.col("_m.n"), "pseudo_key_label": F.col("_m.k")}
    ).drop("_dir", "_d", "_m")


def movement_direction(action_name: Column) -> Column:
    last = F.substring_index(action_name, ".", -1)
    return F.when(last.isin(*DIRECTIONS), last)


def audited(rows: DataFrame) -> DataFrame:
    """rows(n_actions, true_action_id, true_action_name, pseudo_action_id, pseudo_direction) with ``outcome`` and the flags it counts in.

    outcome is the rejection reason or match kind of a transition after its pseudo label was looked at.
    """
    true_direction = movement_direction(F.col("true_action_name"))
    has_pseudo = F.col("pseudo_action_id").isNotNull()
    exact = F.col("true_action_id") == F.col("pseudo_action_id")
    same_way = F.coalesce(true_direction == F.col("pseudo_direction"), F.lit(False))
    outcome = (
        F.when(F.col("n_actions").isNull(), "unmapped_true_keypress")
        .when(F.col("n_actions") > 1, "ambiguous_true_keypress")
        .when(~has_pseudo, "pseudo_label_unavailable")
        .when(exact, "exact_action_id_match")
        .when(same_way, "direction_equivalent_action_alias")
        .when(true_direction.isNull(), "true_nonmovement_but_pseudo_movement")
        .otherwise("movement_direction_mismatch")
    )
    mapped = F.coalesce(F.col("n_actions") == 1, F.lit(False))
    return rows.withColumns({"outcome": outcome, "mapped": mapped, "has_pseudo": has_pseudo, "comparable": mapped & has_pseudo})


def label_audit(rows: DataFrame, dimensions: Sequence[str] = ("role", "race", "alignment")) -> DataFrame:
    """Counts and rates over all audited rows (dimension 'all') and by each value of each dimension, in one pass."""
    filled = rows.select(*[missing_as(F.col(d), "unknown").alias(d) for d in dimensions], "outcome", "mapped", "has_pseudo", "comparable")
    sets = [[], *[[F.col(d)] for d in dimensions]]
    counted = filled.groupingSets(sets, *dimensions).agg(
        *[F.grouping(d).alias(f"_g_{d}") for d in dimensions],
        F.count("*").alias("total"),
        F.count_if("has_pseudo").alias("pseudo_label_available"),
        F.count_if("mapped").alias("mapped_true_keypress"),
        F.count_if("comparable").alias("comparable"),
        F.count_if(F.col("outcome") == "exact_action_id_match").alias("exact"),
        F.count_if(F.col("outcome").isin("exact_action_id_match", "direction_equivalent_action_alias")).alias("equivalent"),
    )
    name, value = F.lit("all"), F.lit("all")
    for d in dimensions:
        name = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(value)
    return counted.select(
        name.alias("dimension"),
        value.alias("value"),
        "total",
        "pseudo_label_available",
        "mapped_true_keypress",
        "comparable",
        "exact",
        "equivalent",
        rate(F.col("exact"), F.col("comparable")).alias("exact_rate"),
        rate(F.col("equivalent"), F.col("comparable")).alias("equivalent_rate"),
    )


def confusion(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    return rows.filter(F.col(true).isNotNull() & F.col(predicted).isNotNull()).groupBy(true, predicted).agg(F.count("*").alias("n"))


def examples(rows: DataFrame, reason: str, limit: int, *, order: Sequence[str]) -> DataFrame:
    """The first rows of each reason."""
    return rows.filter(F.col(reason).isNotNull()).withColumn("example", F.row_number().over(W.partitionBy(reason).orderBy(*order))).filter(F.col("example") <= limit)
