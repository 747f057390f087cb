"""From decoded batches to transitions: flattening, pairing with the next observation, sequences, islands and windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .splits import range_count, ranked


def flatten_batches(batches: DataFrame, arrays: Sequence[str], *, nested: bool) -> DataFrame:
    """One row per position of parallel arrays: (batch, lane, place, columns). Flat batches [N] have lane 0, sequence batches [B, T] one lane per B.

    The batch id has to be a column ``batch``.
    """
    zipped = batches.select("batch", F.posexplode(F.arrays_zip(*arrays)).alias("place", "v"))
    if not nested:
        return zipped.select("batch", F.lit(0).alias("lane"), "place", "v.*")
    lanes = zipped.select("batch", F.col("place").alias("lane"), "v.*")
    return lanes.select("batch", "lane", F.posexplode(F.arrays_zip(*arrays)).alias("place", "v")).select("batch", "lane", "place", "v.*")


def pair_next(rows: DataFrame, value: str, *, lane: Sequence[str], order: Sequence[str], game: str | None = None, done: str | None = None, alias: str = "next_value") -> DataFrame:
    """rows with the value of the next row of the lane: NULL at its end, after ``done`` and where the next row is of another game."""
    w = W.partitionBy(*lane).orderBy(*order)
    following = F.lead(value).over(w)
    guard = F.lit(True)
    if done is not None:
        guard = guard & ~F.coalesce(F.col(done), F.lit(False))
    if game is not None:
        guard = guard & F.coalesce(F.lead(game).over(w) == F.col(game), F.lit(False))
    return rows.withColumn(alias, F.when(guard, following))


def sequence_ids(rows: DataFrame, *, lane: Sequence[str], order: Sequence[str], game: str, stamp: str) -> DataFrame:
    """rows with sequence_id "game:first stamp of the lane"; NULL where the first stamp is."""
    first = F.first(stamp).over(W.partitionBy(*lane).orderBy(*order))
    return rows.withColumn("sequence_id", F.when(first.isNotNull(), F.concat_ws(":", F.col(game).cast("string"), first.cast("string"))))


def islands(rows: DataFrame, *, key: Sequence[str], step: str, order: Sequence[str] = ()) -> DataFrame:
    """rows with ``island``: a new one wherever a step is not the one before plus one, repeats included."""
    w = W.partitionBy(*key).orderBy(step, *order)
    starts = F.when(F.col(step) == F.lag(step).over(w) + 1, 0).otherwise(1)
    return rows.withColumn("_start", starts).withColumn("island", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_start")


def window_availability(rows: DataFrame, *, key: str, step: str, horizons: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row: rows, episodes, segments and the longest; per horizon the windows, frames and segments that are long enough."""
    segments = islands(rows, key=[key], step=step).groupBy(key, "island").agg(F.count("*").alias("n"))
    out = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.countDistinct(key).alias("episode_count"),
        F.count("*").alias("segment_count"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_segment_length"),
    ]
    for h in horizons:
        windows = F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n") - h + 1)), F.lit(0))
        out += [windows.alias(f"next_{h}_windows"), (windows * h).alias(f"next_{h}_frames"), F.count_if(F.col("n") >= h).alias(f"next_{h}_segments")]
    return segments.agg(*out)


def rollout_starts(rows: DataFrame, *, sequence: str, step: str, horizon: int, candidate: Column | None = None) -> DataFrame:
    """Rows whose next ``horizon`` rows are candidates of the same sequence with steps rising by one."""
    w = W.partitionBy(sequence).orderBy(step)
    ahead = w.rowsBetween(0, horizon - 1)
    tagged = rows.withColumn("_ok", F.lit(True) if candidate is None else candidate)
    tagged = tagged.withColumn("_jump", F.when(F.lead(step).over(w) == F.col(step) + 1, 0).otherwise(1))
    tagged = tagged.withColumns(
        {
            "_n": F.count("*").over(ahead),
            "_good": F.count_if("_ok").over(ahead),
            "_jumps": F.sum("_jump").over(w.rowsBetween(0, horizon - 2)) if horizon > 1 else F.lit(0),
        }
    )
    return tagged.filter((F.col("_n") == horizon) & (F.col("_good") == horizon) & (F.col("_jumps") == 0)).drop("_ok", "_jump", "_n", "_good", "_jumps")


def dense_numbers(rows: DataFrame, *, key: str, order: Sequence[str], alias: str = "sequence_number") -> DataFrame:
    """rows with a number from 0 for each key, in the order of its first row.

    The first column of ``order`` (a number or a time) is cut at approximate percentiles, as many as there are ranges; numbers in a range go on from the
    counts of those before. The cuts are one row of the same plan, in blocks of about the square root of their number, so a row is compared with two
    blocks' worth of them. Keys that share that column's value share a range; a null of it comes first.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    lead = F.col("_first")[order[0]]
    if dict(rows.dtypes)[order[0]].startswith(("timestamp", "date")):
        lead = lead.cast("timestamp")
    lead = lead.cast("double")
    ranges = range_count(rows)
    width = math.isqrt(ranges) + 1
    cuts = first.agg(F.array_sort(F.array_distinct(F.percentile_approx(lead, [k / ranges for k in range(1, ranges)], 20 * ranges))).alias("_c"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_c"), F.lit(1)), F.lit(width))
    blocks = cuts.select(F.transform(starts, lambda k: F.slice("_c", k, width)).alias("_blocks"))
    begun = F.size(F.filter("_blocks", lambda b: F.get(b, F.lit(0)) < F.col("_lead")))
    within = F.size(F.filter(F.get("_blocks", F.col("_begun") - 1), lambda c: c < F.col("_lead")))
    place = F.when(F.col("_begun") > 0, (F.col("_begun") - 1) * width + within).otherwise(0)
    placed = first.crossJoin(F.broadcast(blocks)).withColumn("_lead", lead).withColumn("_begun", begun).select(key, "_first", place.alias("_place"))
    numbered = ranked(placed, groups=[], position=(F.col("_place") + 0.5) / ranges, order=["_first", key], alias=alias)
    return rows.join(numbered.select(key, alias), key)


def terminal_reason(observation: Column, rows: int = 24, cols: int = 80) -> Column:
    """Why a terminal plane can't be taken: shape or range; NULL if it can."""
    plane = observation["tty_chars"]
    flat = F.flatten(plane)
    return (
        F.when(plane.isNull(), "missing_terminal_plane")
        .when((F.size(plane) != rows) | ~F.forall(plane, lambda r: F.size(r) == cols), "terminal_shape_invalid")
        .when((F.array_min(flat) < 0) | (F.array_max(flat) > 255), "terminal_value_out_of_range")
    )


def capped_by_split(rows: DataFrame, caps: dict[str, int], *, order: Sequence[str]) -> DataFrame:
    """The first rows of each split up to its cap; the constant bound on the rank is applied before the shuffle."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy("split").orderBy(*order)))
    cap = F.element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))]), F.col("split"))
    return ranked.filter(F.col("_n") <= max(caps.values())).filter(F.col("_n") <= cap).drop("_n")
