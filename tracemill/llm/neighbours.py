"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (``sample`` rows; iterative quantisation: principal axes, then alternating between signs
and the closest rotation) turns each vector into a binary code. The index is cut into shards by a hash of the id; within a
shard the codes are cut into substrings of 8 bits, each with its own table from value to rows. All codes within Hamming radius r of a query agree
with it up to floor(r / m) bits in one of the m substrings at least (the first r mod m + 1 substrings at that, the others one bit less): probing those
values finds every such code. They are checked against r and ranked again by the cosine of the original vectors in double precision.

The radius is measured on the sample: ``quantile`` of the distances between the codes of rows and of their nearest rows there. In
the whole table the nearest are nearer still. Queries with fewer than k rows in the radius are searched again over all codes (radius = all bits).

A shard holds about ``shard_bytes`` of vectors (or fewer, so that there are as many shards as shuffle partitions, down to ``least_rows`` rows each). Its rows are
shuffled to one task, coded and put into tables once; the queries follow them in the same sort order and are answered in batches as they
stream through, k rows a query. So rows + queries * shards vectors are shuffled, and a task holds a shard and a batch.

Defined results: vectors that are null, zero, of another length than ``dimension`` (that of the smallest valid vec_id) or hold null or non-finite values take
no part; rows with the id of a query are its own; a repeated id counts once per query, with its best score, and asks once, with its smallest vector; null ids take no part; an
empty table gives no rows; ties go to the smaller vec_id; columns other than vec_id, embedding and those of the query condition are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RESULT = "query_id long, vec_id long, score double"
_CLOSE = 1e-9


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension, bits) of iterative quantisation."""
    mean = x.mean(axis=0)
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    v = centred @ axes
    r = np.linalg.qr(np.random.default_rng(7).standard_normal((axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as bytes (rows, bits / 8); missing bits of the last byte are 0."""
    return np.packbits((x - mean) @ projection >= 0, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def measured_radius(x: np.ndarray, codes: np.ndarray, k: int, quantile: float) -> int:
    """``quantile`` of the code distances from every 8th row of the sample to its k nearest rows there."""
    unit, found = _unit(x), []
    for q in range(0, len(x), 8):
        cosine = unit @ unit[q]
        cosine[q] = -2
        near = np.argpartition(-cosine, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else []
        found.extend(_distances(codes[near], codes[q]))
    return int(np.quantile(found, quantile)) if found else codes.shape[1] * 8


class Tables:
    """The tables of one shard: for each byte of the code, rows sorted by its value and where each value starts."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.rows = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[r, j], np.arange(257)) for j, r in enumerate(self.rows)]
        self.masks = [np.array([sum(1 << b for b in c) for n in range(t + 1) for c in combinations(range(8), n)], dtype=np.int64) for t in range(9)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius."""
        m = self.codes.shape[1]
        t, rest = divmod(min(radius, 8 * m), m)
        seen = np.zeros(len(self.codes), dtype=bool)
        for j in range(m):
            bits = min(8, t if j <= rest else t - 1)
            if bits < 0:
                continue
            values = int(code[j]) ^ self.masks[bits]
            low, high = self.starts[j][values], self.starts[j][values + 1]
            sizes = high - low
            ends = np.cumsum(sizes)
            seen[self.rows[j][np.arange(ends[-1]) + np.repeat(low - ends + sizes, sizes)]] = True
        rows = np.flatnonzero(seen)
        return rows[_distances(self.codes[rows], code) <= radius]


def _valid(x: Column, dimension: int) -> Column:
    d = x.cast("array<double>")
    return x.isNotNull() & (F.size(x) == dimension) & F.forall(d, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(d, lambda v: v != 0)


class Shard:
    """The rows of one shard, coded and in tables, to be asked."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> None:
        self.ids, self.x, self.norms, self.model = ids, x, np.linalg.norm(x, axis=1), (mean, projection)
        self.tables = Tables(encode(_unit(x), mean, projection))

    def asked(self, query_ids: np.ndarray, q: np.ndarray, radius: int, k: int) -> pa.RecordBatch:
        """The k nearest found of each query: by one product first, then, from just below the k-th, by sums that don't depend on the place of a row."""
        codes, out = encode(_unit(q), *self.model), []
        for query_id, vector, code in zip(query_ids, q, codes, strict=True):
            near = self.tables.within(code, radius)
            near = near[self.ids[near] != query_id]
            length = np.linalg.norm(vector)
            rough = (self.x[near] @ vector) / (self.norms[near] * length)
            kept = k
            while True:
                best = near[rough >= np.partition(rough, -kept)[-kept] - _CLOSE] if len(near) > kept else near
                score = (self.x[best] * vector).sum(axis=1) / (self.norms[best] * length)
                order = np.lexsort((self.ids[best], -score))
                order = order[np.sort(np.unique(self.ids[best][order], return_index=True)[1])[:k]]
                if len(order) == k or len(best) == len(near):
                    break
                kept *= 4  # ids were repeated
            out.append((np.full(len(order), query_id), self.ids[best][order], score[order]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, *, sample: int = 4096, quantile: float = 0.985, shard_bytes: int = 2**25, least_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows of every query row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("is_query")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = rows.filter(_valid(F.col("v"), F.size("v")))
    first = finite.orderBy("vec_id", F.size("v")).select(F.size("v").alias("n")).limit(1).collect()
    if not first:
        return empty
    dimension = first[0]["n"]
    rows = common.written(finite.filter(F.size("v") == dimension), "vectors")
    total = rows.count()
    learned = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()])
    # directions matter, so codes are those of unit vectors
    mean, projection = learn_rotation(_unit(learned), dimension)
    radius = measured_radius(learned, encode(_unit(learned), mean, projection), k, quantile)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(1, -(-total * dimension * 8 // shard_bytes), min(ranges, -(-total // least_rows)))
    queries = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))

    def scanned(queries: DataFrame, radius: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, ids, held, shard = None, [], [], None
            for batch in batches:
                numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(numbers)]
                for first, last in zip(cuts, cuts[1:]):
                    if first == last:
                        continue
                    part = batch.slice(first, last - first)
                    if numbers[first] != number:
                        number, ids, held, shard = numbers[first], [], [], None
                    if not asks[first]:
                        ids.append(part.column(2).to_numpy())
                        held.append(_matrix(part.column(3)))
                    elif held or shard:
                        if shard is None:
                            shard, ids, held = Shard(np.concatenate(ids), np.concatenate(held), mean, projection), [], []
                        yield shard.asked(part.column(2).to_numpy(), _matrix(part.column(3)), radius, k)
            common.release()

        index = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v")
        asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("qv").alias("v"))
        dealt = index.union(asked).repartition(ranges, "shard").sortWithinPartitions("shard", "asks")
        found = dealt.mapInArrow(run, RESULT)
        return found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))

    queries = queries.groupBy("query_id").agg(F.min("qv").alias("qv"))
    found = common.written(scanned(queries, radius), "neighbours")
    short = queries.join(found.filter(F.size("best") >= k), "query_id", "left_anti")
    if short.limit(1).count():
        again = scanned(short, dimension)
        found = found.filter(F.size("best") >= k).union(again)
    return found.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
