"""World-model tables: planes of cells of a transition, their targets, candidates for ranking, and the table as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import f1, let, rate
from ..streaming.ledger import shared_folder
from . import metrics, splits, transitions

PLANES = ("current_chars", "current_colors", "next_chars", "next_colors")
#: Numbers of the splits in a table.
SPLIT_CODES = {"train": 0, "validation": 1, "test": 2}


def changed_f1(current: str = "current", truth: str = "next", prediction: str = "pred") -> Column:
    """F1 of the cells that change in character or colour, of one example; 0 where a part of it is undefined."""

    def changed(side: str) -> Column:
        pairs = [F.zip_with(f"{current}_{k}", f"{side}_{k}", lambda a, b: a != b) for k in ("chars", "colors")]
        return F.zip_with(*pairs, lambda a, b: a | b)

    count = lambda x: F.size(F.filter(x, lambda v: v))
    both = F.zip_with(changed(truth), changed(prediction), lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    counts = let(both, lambda x: F.struct(count(F.transform(x, lambda v: v["t"] & v["p"])).alias("tp"), count(F.transform(x, lambda v: v["t"])).alias("t"), count(F.transform(x, lambda v: v["p"])).alias("p")))
    return let(counts, lambda c: f1(rate(c["tp"], c["p"]), rate(c["tp"], c["t"])))


def delta_targets() -> list[Column]:
    """char_delta and color_delta: 0 where a cell stays, else its new value + 1."""
    return [metrics.terminal_delta(F.col(f"current_{k}s"), F.col(f"next_{k}s")).alias(f"{k}_delta") for k in ("char", "color")]


def candidates(rows: DataFrame, training: DataFrame, *, row: str, action: str, count: int) -> DataFrame:
    """(row, candidate, is_true): the true action of each row and the ``count - 1`` most frequent others of the training rows, ties to the smallest.

    Rows whose action the training rows lack have no candidates; fewer than ``count`` actions there are an error. The list of actions is as small as a keyboard.
    """
    if count < 2:
        raise ValueError("a ranking needs two candidates at least")
    counted = training.groupBy(action).agg(F.count("*").alias("_n"))
    listed = counted.agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), F.col(action).alias("a")))).alias("_list")).select(F.transform("_list", lambda x: x["a"]).alias("_actions"))
    seen = rows.crossJoin(F.broadcast(listed)).filter(F.array_contains("_actions", F.col(action)))
    enough = F.when(F.size("_actions") >= count, F.col("_actions")).otherwise(F.raise_error(F.lit("too few actions in the training rows")))
    chosen = F.slice(F.concat(F.array(action), F.filter(enough, lambda x: x != F.col(action))), 1, count)
    return seen.select(row, F.explode(chosen).alias("candidate"), F.col(action).alias("_true")).select(row, "candidate", (F.col("candidate") == F.col("_true")).alias("is_true"))


def revealed(cells: Column, remaining: Column) -> Column:
    """array<struct<value, masked, prediction, confidence>> with the surest masked cells revealed until ``remaining`` are left; ties to the first."""
    tagged = F.transform(cells, lambda c, k: F.struct(c["masked"].alias("m"), (-c["confidence"]).alias("s"), k.alias("k")))
    ordered = let(F.array_sort(F.filter(tagged, lambda x: x["m"])), lambda x: F.slice(x, 1, F.greatest(F.size(x) - remaining, F.lit(0))))
    chosen = F.transform(ordered, lambda x: x["k"])
    with_chosen = F.transform(cells, lambda c, k: F.struct(c.alias("c"), k.alias("k")))
    return F.transform(
        with_chosen,
        lambda x: F.when(F.array_contains(chosen, x["k"]), F.struct(x["c"]["prediction"].alias("value"), F.lit(False).alias("masked"), x["c"]["prediction"].alias("prediction"), x["c"]["confidence"].alias("confidence"))).otherwise(x["c"]),
    )


def collected(rows: DataFrame, seed: int, caps: dict[str, int], *, order: Sequence[str]) -> DataFrame:
    """rows(gameid, PLANES as arrays ...) with split and split_code, sequence numbers within a game, planes as bytes, and at most ``caps`` rows of a split."""
    if set(caps) != set(SPLIT_CODES) or min(caps.values()) <= 0:
        raise ValueError("each split needs a positive cap")
    code = F.element_at(F.create_map(*[x for k, v in SPLIT_CODES.items() for x in (F.lit(k), F.lit(v))]), F.col("split"))
    kept = transitions.capped_by_split(splits.with_split(rows, "gameid", seed), caps, order=order).withColumn("split_code", code)
    hexed = lambda c: F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return kept.withColumns({c: hexed(F.col(c)) for c in PLANES} | {"sequence_step": F.row_number().over(W.partitionBy("gameid").orderBy(*order)) - 1})


def checked(rows: DataFrame) -> DataFrame:
    """The rows, of which none may lack a plane or have planes of different sizes, as the table is read."""
    sizes = F.array(*[F.octet_length(c) for c in PLANES])
    good = F.forall(sizes, lambda x: x.isNotNull()) & (F.array_min(sizes) == F.array_max(sizes))
    return rows.withColumn("split_code", F.when(good, F.col("split_code")).otherwise(F.raise_error(F.lit("a plane is missing or of another size"))))


def split_failures(rows: DataFrame) -> DataFrame:
    """rows(split, gameid): splits that have no rows (gameid NULL), and games that several splits have."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(s,) for s in SPLIT_CODES], "split string")
    missing = wanted.join(rows.select("split").distinct(), "split", "left_anti").select("split", F.lit(None).cast("long").alias("gameid"), F.lit("split_without_rows").alias("failure"))
    shared = rows.select("split", "gameid").distinct().withColumn("_n", F.count("*").over(W.partitionBy("gameid"))).filter("_n > 1")
    return missing.union(shared.select("split", "gameid", F.lit("game_in_several_splits")))


def round_trip(rows: DataFrame) -> DataFrame:
    """The table written as Parquet by split, and read again."""
    folder = shared_folder(rows.sparkSession, "planes")
    rows.write.partitionBy("split").parquet(folder)
    return checked(rows.sparkSession.read.schema(rows.schema).parquet(folder))


def merged_counts(workers: DataFrame) -> DataFrame:
    """workers(worker, split, reason, n): rows taken (no reason) and turned away, summed over workers."""
    return workers.groupBy("split", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.sum("n").alias("n"), F.countDistinct("worker").alias("workers"))
