"""Metrics of predictions: actions, text frames, planes of cells, losses and rankings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import frames
from ..functions.scalars import f1, missing_as, rate
from ..functions.similarity import similarity_ratio


def policy_metrics(rows: DataFrame, valid: Column, *, prediction: str = "prediction", label: str = "label", parsed: Column | None = None) -> DataFrame:
    """One row of policy metrics; rows are first reduced to one per (label, prediction) cell.

    Ties for the dominant action go to the smallest; a missing prediction parses to nothing and matches nothing.
    """
    parsed = F.col(prediction).isNotNull() if parsed is None else parsed
    cells = rows.groupBy(label, prediction).agg(F.count("*").alias("n"), F.count_if(parsed).alias("parsed"), F.count_if(parsed & valid).alias("in_space"), F.count_if(F.col(prediction) == F.col(label)).alias("exact"))
    targets = cells.groupBy(label).agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"))
    predicted = cells.groupBy(prediction).agg(F.sum("in_space").alias("n")).filter("n > 0")
    first = lambda name: F.min_by(name, F.struct(-F.col("n"), name))
    top = targets.agg(first(label).alias("target_dominant"), F.count("*").alias("target_unique"), F.avg(rate(F.col("exact"), F.col("n"))).alias("macro"))
    top_predicted = predicted.agg(first(prediction).alias("predicted_dominant"), F.count("*").alias("predicted_unique"), F.coalesce(F.max("n"), F.lit(0)).alias("predicted_top"))
    total = cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "parsed", "in_space", "exact")])
    others = targets.crossJoin(top).filter(F.col(label) != F.col("target_dominant")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("other_n"), F.coalesce(F.sum("exact"), F.lit(0)).alias("other_exact"))
    one = total.crossJoin(top).crossJoin(top_predicted).crossJoin(others)
    return one.select(
        F.col("n").alias("row_count"),
        "exact",
        F.round(rate(F.col("parsed"), F.col("n")), 6).alias("parse_valid_rate"),
        F.round(rate(F.col("in_space"), F.col("n")), 6).alias("action_space_valid_rate"),
        F.round(rate(F.col("exact"), F.col("n")), 6).alias("exact_match_rate"),
        F.round(F.coalesce("macro", F.lit(0.0)), 6).alias("macro_action_accuracy"),
        F.round(rate(F.col("other_exact"), F.col("other_n")), 6).alias("non_modal_exact_match_rate"),
        "predicted_unique",
        "predicted_dominant",
        F.round(rate(F.col("predicted_top"), F.col("n")), 6).alias("predicted_dominant_rate"),
        "target_unique",
        "target_dominant",
        (rate(F.col("predicted_top"), F.col("n")) > 0.5).cast("int").alias("dominant_action_collapse"),
    )


def by_role(rows: DataFrame, role: str, correct: Column) -> DataFrame:
    return rows.groupBy(missing_as(F.col(role), "unknown").alias("role")).agg(F.count("*").alias("n"), F.count_if(correct).alias("exact")).withColumn("rate", F.round(rate(F.col("exact"), F.col("n")), 6))


def frame_metrics(rows: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row: exact frames, characters in place, exact MAP and MESSAGE sections, messages equal after normalising, message similarity."""
    p, t = F.col(prediction), F.col(label)
    per_row = rows.select(
        (p == t).alias("exact"),
        frames.matching_characters(p, t).alias("matching"),
        frames.longest_length(p, t).alias("characters"),
        (frames.section(p, "MAP:") == frames.section(t, "MAP:")).alias("map_exact"),
        (frames.section(p, "MESSAGE:") == frames.section(t, "MESSAGE:")).alias("message_exact"),
        (frames.normalized_message(p) == frames.normalized_message(t)).alias("message_normalized"),
        similarity_ratio(frames.normalized_message(p), frames.normalized_message(t)).alias("similarity"),
    )
    n = F.count("*")
    return per_row.agg(
        n.alias("row_count"),
        rate(F.count_if("exact"), n).alias("exact_match_rate"),
        rate(F.sum("matching"), F.sum("characters")).alias("char_accuracy"),
        rate(F.count_if("map_exact"), n).alias("map_line_exact_rate"),
        rate(F.count_if("message_exact"), n).alias("message_exact_rate"),
        rate(F.count_if("message_normalized"), n).alias("message_normalized_exact_rate"),
        F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("message_edit_similarity"),
    )


def changed_state_metrics(rows: DataFrame, current: str = "current_frame", prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row: precision, recall and F1 of changed map cells (right character needed), copies of unchanged cells, player place, BLSTATS fields and turn."""
    number = lambda x: x.try_cast("double")
    mapped = rows.select(*[frames.map_grid(F.col(c)).alias(n) for c, n in ((current, "c"), (prediction, "p"), (label, "t"))], *[frames.player_position(frames.map_cells(F.col(c))).alias(n) for c, n in ((prediction, "pp"), (label, "tp"))],
                         *[frames.blstats_values(F.col(c)).alias(n) for c, n in ((current, "cb"), (prediction, "pb"), (label, "tb"))])
    none = F.array().cast("array<string>")
    both = lambda a, b: F.zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda x, y: F.struct(x.alias("c"), y.alias("p")))
    line = lambda cp, t: F.zip_with(F.coalesce(cp, F.array().cast("array<struct<c: string, p: string>>")), F.coalesce(t, none), lambda x, y: F.struct(x["c"].alias("c"), x["p"].alias("p"), y.alias("t")))
    state = F.flatten(F.zip_with(F.zip_with("c", "p", both), F.col("t"), line))
    count = lambda test: F.size(F.filter("s", test))
    changed = lambda x, n: ~x[n].eqNullSafe(x["c"])
    fields = F.transform("tb", lambda v, k: F.struct(v.alias("t"), F.get("pb", k).alias("p")))
    per_row = mapped.withColumn("s", state).select(
        count(lambda x: changed(x, "t")).alias("true_changed"),
        count(lambda x: changed(x, "p")).alias("predicted_changed"),
        count(lambda x: changed(x, "t") & changed(x, "p") & x["p"].eqNullSafe(x["t"])).alias("correct_changed"),
        count(lambda x: ~changed(x, "t")).alias("unchanged"),
        count(lambda x: ~changed(x, "t") & ~changed(x, "p")).alias("copied"),
        F.coalesce(F.col("pp") == F.col("tp"), F.lit(False)).cast("int").alias("player"),
        F.col("pb").isNotNull().cast("int").alias("parsed"),
        F.coalesce(F.size("tb"), F.lit(0)).alias("fields"),
        F.coalesce(F.size(F.filter(fields, lambda x: x["t"].eqNullSafe(x["p"]))), F.lit(0)).alias("fields_exact"),
        F.coalesce(F.size(F.filter(fields, lambda x: number(x["t"]).isNotNull())), F.lit(0)).alias("numeric"),
        F.coalesce(F.size(F.filter(fields, lambda x: number(x["t"]).isNotNull() & number(x["p"]).isNotNull())), F.lit(0)).alias("comparable"),
        F.coalesce(F.aggregate(fields, F.lit(0.0), lambda a, x: a + F.coalesce(F.abs(number(x["p"]) - number(x["t"])), F.lit(0.0))), F.lit(0.0)).alias("error"),
        (number(F.get("pb", F.lit(20))) - number(F.get("cb", F.lit(20)))).alias("predicted_turn"),
        (number(F.get("tb", F.lit(20))) - number(F.get("cb", F.lit(20)))).alias("true_turn"),
    )
    n = F.count("*")
    sums = per_row.agg(
        n.alias("row_count"), *[F.sum(c).alias(c) for c in per_row.columns[:-2]],
        F.count(F.col("predicted_turn") + F.col("true_turn")).alias("turns"), F.count_if(F.col("predicted_turn") == F.col("true_turn")).alias("turns_exact"),
    )
    precision, recall = rate(F.col("correct_changed"), F.col("predicted_changed")), rate(F.col("correct_changed"), F.col("true_changed"))
    return sums.select(
        "row_count",
        rate(F.col("player"), F.col("row_count")).alias("player_coordinate_exact_rate"),
        precision.alias("changed_map_cell_precision"),
        recall.alias("changed_map_cell_recall"),
        f1(precision, recall).alias("changed_map_cell_f1"),
        rate(F.col("copied"), F.col("unchanged")).alias("unchanged_map_cell_copy_rate"),
        rate(F.col("parsed"), F.col("row_count")).alias("blstats_parse_valid_rate"),
        rate(F.col("fields_exact"), F.col("fields")).alias("blstats_field_exact_rate"),
        rate(F.col("error"), F.col("comparable")).alias("blstats_numeric_mae"),
        rate(F.col("comparable"), F.col("numeric")).alias("blstats_numeric_comparable_rate"),
        rate(F.col("turns_exact"), F.col("turns")).alias("game_turn_delta_exact_rate"),
    )


def failure_rates(rows: DataFrame, failure: str, kinds: Sequence[str] = ("truncated_json", "invalid_json", "wrong_schema", "wrong_value_type")) -> DataFrame:
    """One row: the share of each kind of parse failure, 0 where there is none."""
    return rows.agg(F.count("*").alias("row_count"), *[rate(F.count_if(F.col(failure) == k), F.count("*")).alias(f"{k}_rate") for k in kinds])


def teacher_forced(rows: DataFrame) -> DataFrame:
    """rows(nll_sum, token_count, correct_tokens) -> mean loss, perplexity and token accuracy; rows without tokens don't count."""
    own = rows.filter("token_count > 0").agg(F.count("*").alias("row_count"), F.sum("nll_sum").alias("nll"), F.sum("token_count").alias("tokens"), F.sum("correct_tokens").alias("correct"))
    mean = rate(F.col("nll"), F.col("tokens"))
    return own.select("row_count", "tokens", mean.alias("mean_nll"), F.exp(F.least(mean, F.lit(100.0))).alias("perplexity"), rate(F.col("correct"), F.col("tokens")).alias("token_accuracy"))


def copy_baseline(rows: DataFrame, *, sequence: str, step: str, frame: str, horizon: int, order: Sequence[str] = ()) -> DataFrame:
    """For every window of ``horizon`` rows of a sequence with steps rising by one: its first frame against the frame of each of its rows."""
    from .transitions import islands

    own = islands(rows, key=[sequence], step=step, order=order)
    w = W.partitionBy(sequence, "island").orderBy(step)
    windows = own.withColumn("_frames", F.collect_list(frame).over(w.rowsBetween(0, horizon - 1))).filter(F.size("_frames") == horizon)
    return windows.select(sequence, F.col(step).alias("start"), F.col("_frames")[0].alias("prediction"), F.posexplode("_frames").alias("offset", "label"))


def predicted_rollouts(starts: DataFrame, predictor: Callable[[pd.Series, pd.Series], pd.Series], *, key: Sequence[str], frame: str = "frame", actions: str = "actions") -> DataFrame:
    """starts(key, frame, actions: array) -> (key, offset from 1, action, prediction): a predictor fed with its own frames, one action at a time.

    ``predictor(frames, actions)`` takes a step of all rollouts of a batch at once; rollouts end with their actions. Models are the caller's.
    """
    fields = starts.select(*key, F.lit(1).alias("offset"), F.element_at(actions, 1).alias("action"), F.col(frame).alias("prediction")).schema

    def run(batches):
        for batch in batches:
            left = batch[[*key, frame, actions]].rename(columns={frame: "prediction"}).reset_index(drop=True)
            left["prediction"] = left["prediction"].astype(object)
            lengths, step = left[actions].map(lambda a: 0 if a is None else len(a)), 0
            while (lengths > step).any():
                left, lengths = left[lengths > step].reset_index(drop=True), lengths[lengths > step].reset_index(drop=True)
                now = left[actions].map(lambda a, k=step: a[k])
                left["prediction"] = pd.Series(list(predictor(left["prediction"], now)), dtype=object)
                step += 1
                yield left[[*key]].assign(offset=step, action=now, prediction=left["prediction"])

    return starts.select(*key, frame, actions).mapInPandas(run, fields)


def with_truth(predictions: DataFrame, truths: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """predictions(key, offset, prediction) with the true frame of truths(key, offset, truth), NULL past the last one, and the share of characters in place."""
    joined = predictions.join(truths.select(*key, "offset", "truth"), [*key, "offset"], "left")
    return joined.withColumns({"exact": F.col("prediction") == F.col("truth"), "char_accuracy": F.when(F.col("truth").isNotNull(), frames.char_accuracy(F.col("prediction"), F.col("truth")))})


# Planes of cells: arrays of equal length


def terminal_delta(current: Column, following: Column) -> Column:
    """0 where a cell stays, else its new value + 1."""
    return F.zip_with(current, following, lambda a, b: F.when(a == b, 0).otherwise(b + 1))


def apply_terminal_delta(current: Column, delta: Column) -> Column:
    return F.zip_with(current, delta, lambda a, d: F.when(d == 0, a).otherwise(d - 1))


def plane_sums(current: Column, truth: Column, prediction: Column, map_cells: int) -> list[Column]:
    """Additive counts of one example over three planes; the first ``map_cells`` cells are map, the rest status."""
    cells = F.zip_with(F.zip_with(current, truth, lambda c, t: F.struct(c.alias("c"), t.alias("t"))), prediction, lambda x, p: F.struct(x["c"].alias("c"), x["t"].alias("t"), p.alias("p")))
    count = lambda part, test: F.size(F.filter(part, test)).cast("long")
    own_map, status = F.slice(cells, 1, map_cells), F.slice(cells, map_cells + 1, F.size(cells))
    return [
        F.size(cells).cast("long").alias("cells"),
        count(cells, lambda x: x["p"] == x["t"]).alias("char_correct"),
        F.forall(cells, lambda x: x["p"] == x["t"]).cast("long").alias("exact_frames"),
        count(cells, lambda x: x["t"] != x["c"]).alias("true_changed"),
        count(cells, lambda x: x["p"] != x["c"]).alias("predicted_changed"),
        count(cells, lambda x: (x["t"] != x["c"]) & (x["p"] == x["t"])).alias("correct_changed"),
        count(cells, lambda x: (x["t"] != x["c"]) & (x["p"] != x["c"])).alias("true_positive_changed"),
        count(own_map, lambda x: x["p"] == x["t"]).alias("map_char_correct"),
        F.size(own_map).cast("long").alias("map_cells"),
        count(status, lambda x: x["p"] == x["t"]).alias("status_char_correct"),
        F.size(status).cast("long").alias("status_cells"),
    ]


def plane_metrics(sums: DataFrame) -> DataFrame:
    """One row from rows of plane_sums: their totals and the ratios over them; position alone makes a true positive."""
    total = sums.agg(F.count("*").alias("examples"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns])
    precision, recall = rate(F.col("true_positive_changed"), F.col("predicted_changed")), rate(F.col("true_positive_changed"), F.col("true_changed"))
    return total.select(
        "*",
        F.round(rate(F.col("char_correct"), F.col("cells")), 6).alias("char_accuracy"),
        F.round(rate(F.col("exact_frames"), F.col("examples")), 6).alias("exact_frame_rate"),
        F.round(precision, 6).alias("changed_cell_precision"),
        F.round(recall, 6).alias("changed_cell_recall"),
        F.round(f1(precision, recall), 6).alias("changed_cell_f1"),
        F.round(rate(F.col("correct_changed"), F.col("true_changed")), 6).alias("changed_cell_char_accuracy"),
        F.round(rate(F.col("map_char_correct"), F.col("map_cells")), 6).alias("map_char_accuracy"),
        F.round(rate(F.col("status_char_correct"), F.col("status_cells")), 6).alias("status_char_accuracy"),
    )


def binary_plane_sums(rows: DataFrame, prediction: str = "pred", map_cells: int = 22 * 80) -> DataFrame:
    """The same counts, with colors, from binary planes (current, next and predicted chars and colors), batch by batch in numpy; a row per batch."""
    names = ("examples", "cells", "char_correct", "color_correct", "exact_frames", "true_changed", "predicted_changed", "correct_changed", "true_positive_changed", "map_char_correct", "map_cells", "status_char_correct", "status_cells")
    planes = [f"{side}_{kind}" for side in ("current", "next", prediction) for kind in ("chars", "colors")]

    def run(batches):
        for batch in batches:
            cc, ck, tc, tk, pc, pk = (np.stack([np.frombuffer(x, dtype=np.uint8) for x in batch[p]]) for p in planes)
            changed, guessed = (tc != cc) | (tk != ck), (pc != cc) | (pk != ck)
            same, same_color = pc == tc, pk == tk
            values = (
                len(cc), cc.size, same.sum(), same_color.sum(), (same & same_color).all(axis=1).sum(), changed.sum(), guessed.sum(), (same & changed).sum(), (changed & guessed).sum(),
                same[:, :map_cells].sum(), same[:, :map_cells].size, same[:, map_cells:].sum(), same[:, map_cells:].size,
            )
            yield pd.DataFrame([dict(zip(names, map(int, values), strict=True))])

    return rows.select(*planes).mapInPandas(run, ", ".join(f"{n} long" for n in names))


def bootstrap_interval(pairs: DataFrame, *, seed: int, samples: int = 5000, confidence: float = 0.95) -> DataFrame:
    """Interval of the mean of candidate - baseline by the Poisson bootstrap.

    Each pair has its own weight in each of ``samples`` resamples, from a hash of seed, key and resample, so that reruns agree; the table is read
    once in place, a block of pairs at a time, and tasks return sums per resample, merged by key.
    """

    def run(batches):
        weight, total = np.zeros(samples), np.zeros(samples)
        for batch in batches:
            keys, d = batch["key"].to_numpy(dtype=np.int64), batch["d"].to_numpy(dtype=float)
            for first in range(0, len(keys), 64):
                w = poisson_weights(seed, keys[first : first + 64], samples)
                weight += w.sum(axis=0)
                total += d[first : first + 64] @ w
        yield pd.DataFrame({"resample": np.arange(samples), "w": weight, "t": total})

    rows = pairs.select(F.col("key"), (F.col("candidate") - F.col("baseline")).alias("d"))
    means = rows.mapInPandas(run, "resample int, w double, t double").groupBy("resample").agg((F.sum("t") / F.sum("w")).alias("mean"))
    tail = (1 - confidence) / 2
    bounds = means.agg(F.percentile("mean", F.lit(tail)).alias("lower"), F.percentile("mean", F.lit(1 - tail)).alias("upper"))
    return rows.agg(F.count("*").alias("pairs"), F.avg("d").alias("mean_difference")).crossJoin(bounds)


#: Cumulative probabilities of 0, 1, 2 ... under the Poisson law of mean 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 16)])))


def poisson_weights(seed: int, keys: np.ndarray, samples: int) -> np.ndarray:
    """(keys, samples) weights of mean 1: a hash of (seed, key, resample) as a uniform number, through the inverse distribution."""
    x = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & 0xFFFFFFFF))[:, None] + np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (x ^ (x >> np.uint64(31))) / 2.0**64, side="right").astype(float)


def action_ranking(scores: DataFrame, *, row: str, action: str, true_action: str, score: str) -> DataFrame:
    """One row: mean reciprocal rank (as many ranks down as scores are at least the true one's) and strict top-1 share, from one row per (row, candidate)."""
    own = scores.groupBy(row).agg(F.max(F.when(F.col(action) == F.col(true_action), F.col(score))).alias("_true"), F.collect_list(score).alias("_all"))
    rank = F.size(F.filter("_all", lambda x: x >= F.col("_true")))
    others = F.size(F.filter("_all", lambda x: x > F.col("_true")))
    return own.filter("_true IS NOT NULL").agg(F.count("*").alias("row_count"), F.avg(1.0 / rank).alias("mrr"), F.avg(((rank == 1) & (others == 0)).cast("int")).alias("top1_rate"))


def best_action(scores: DataFrame, *, row: str, action: str, score: str, valid: Sequence[int] | None = None) -> DataFrame:
    """The valid action of the highest score, ties to the smallest."""
    own = scores if valid is None else scores.filter(F.col(action).isin(*valid))
    return own.groupBy(row).agg(F.max_by(action, F.struct(F.col(score), -F.col(action))).alias(action))


def loss_summary(history: DataFrame) -> DataFrame:
    """history(step, loss) -> count, first, last, least loss and whether it fell."""
    return history.filter("loss IS NOT NULL").agg(
        F.count("*").alias("count"), F.min_by("loss", "step").alias("first"), F.max_by("loss", "step").alias("last"), F.min("loss").alias("min"), (F.max_by("loss", "step") < F.min_by("loss", "step")).alias("decreased")
    )
