"""Splits, orders and samples by hash: the same on every run, without shuffling in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_bucket, missing_as, split_name


def with_split(rows: DataFrame, key: str, seed: int, train: float = 0.90, validation: float = 0.05) -> DataFrame:
    return rows.withColumn("split", split_name(hash_bucket(seed, F.col(key)), train, validation))


def top_by_hash(rows: DataFrame, key: str, seed: int, counts: dict[str, int]) -> DataFrame:
    """The first keys of each split by sha256("seed:split:key"), as many as counts says.

    The constant bound on the rank lets Spark keep the first rows of each split before it shuffles them.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("split"), F.col(key).cast("string")).cast("binary"), 256)
    wanted = F.element_at(F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(v))]), F.col("split"))
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy("split").orderBy(digest, key)))
    return ranked.filter(F.col("_n") <= max(counts.values())).filter(F.col("_n") <= wanted).drop("_n")


LEAST_RANGES = 64


def range_count(rows: DataFrame) -> int:
    """Into how many ranges an order is cut: one for each shuffle partition, which a cluster sets by the size of its data, and LEAST_RANGES at least."""
    return max(LEAST_RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows in as many parts by a hash of the key as there are ranges: a join on it sorts these parts, which aren't merged into larger ones before."""
    return rows.repartition(range_count(rows), key)


def range_of(position: Column, ranges: int) -> Column:
    """The range, from 0, that a position from 0 to 1 falls into."""
    return F.least(F.floor(position * ranges), F.lit(ranges - 1)).cast("int")


def ranked(rows: DataFrame, *, groups: Sequence[str], position: Column, order: Sequence[Column | str], alias: str) -> DataFrame:
    """rows with their rank from 0 within the group, in the order of ``position`` (a number from 0 to 1) and then of ``order``.

    Positions are cut into ranges; ranks within a range go on from the summed counts of the ranges before, so that no task sorts a group. There are as
    many ranges as shuffle partitions, so a range of the largest group gets smaller as the cluster's settings grow with the data.
    """
    cut = rows.withColumn("_position", position).withColumn("_range", range_of(F.col("_position"), range_count(rows)))
    keys = [*groups, "_range"]
    before = W.partitionBy(*[f"_b{k}" for k in range(len(groups))]).orderBy("_b_range").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.groupBy(*keys).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_b{k}") for k, c in enumerate(groups)], F.col("_range").alias("_b_range"), "_n")
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = cut.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("_position", *order)) - 1)
    joined = own.join(base, [*[F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(groups)], F.col("_range") == F.col("_b_range")])
    return joined.withColumn(alias, (F.col("_base") + F.col("_k")).cast("int")).select(*rows.columns, alias)


def split_role_order(games: DataFrame, seed: int) -> DataFrame:
    """games(gameid, role) with split, role filled and (turn, role, split_rank), by which a build visits them."""
    rows = with_split(games, "gameid", seed).withColumn("role", missing_as(F.col("role"), "<missing>"))
    rows = rows.withColumn("split_rank", F.when(F.col("split") == "validation", 0).when(F.col("split") == "test", 1).otherwise(2))
    return ranked(rows, groups=["split", "role"], position=hash_bucket(seed + 1, F.col("gameid")), order=["gameid"], alias="turn")


def stratified(rows: DataFrame, *, strata: Sequence[str], key: str, seed: int, limit: int) -> DataFrame:
    """``limit`` rows, one of each stratum in turn, in hash order within each."""
    turned = ranked(rows, groups=strata, position=hash_bucket(seed, F.col(key)), order=[key], alias="turn")
    return turned.orderBy("turn", *strata).limit(limit)


def overlaps(rows: DataFrame, key: str) -> DataFrame:
    """Pairs of splits that share keys: left, right, overlap_count. One row per (key, split) meets, however many rows there are."""
    sides = rows.select(key, "split").distinct().groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    pairs = sides.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r")))))).alias("p"))
    return pairs.groupBy(F.col("p.l").alias("left_split"), F.col("p.r").alias("right_split")).agg(F.count("*").alias("overlap_count"))


def bernoulli(rows: DataFrame, key: str, seed: int, ratio: float) -> DataFrame:
    """Each row with probability ``ratio`` by its hash; none at 0 and below, all at 1 and above."""
    if ratio <= 0:
        return rows.filter(F.lit(False))
    return rows if ratio >= 1 else rows.filter(hash_bucket(seed, F.col(key)) < ratio)


def exact_sample(rows: DataFrame, key: str, seed: int, count: int) -> DataFrame:
    """``count`` rows in hash order, back in the order of the key."""
    return rows.orderBy(hash_bucket(seed, F.col(key)), key).limit(count).orderBy(key)


def share_sample(rows: DataFrame, key: str, seed: int, ratio: float) -> DataFrame:
    """int(n * ratio) of the n rows, the first ones in hash order; all in one plan."""
    total = rows.agg(F.floor(F.count("*") * F.lit(float(ratio))).alias("_wanted"))
    placed = ranked(rows, groups=[], position=hash_bucket(seed, F.col(key)), order=[key], alias="_rank")
    return placed.crossJoin(F.broadcast(total)).filter(F.col("_rank") < F.col("_wanted")).select(*rows.columns)
