"""Periodic runs of words: suffix classes united by descending common prefix, with ordered positions.

A run is a stretch of words with a smallest period q, of at least 12 words and 2 q, that can't be made longer. Its first word and the word q later begin suffixes
whose common prefix is the rest of the run. So suffixes are sorted, their classes united from the longest common prefix downwards (Kruskal's order, union-find with
the positions of each class in order), and two positions that become neighbours no further apart than that prefix are a run, if no word before or behind extends it:
any shorter period would have put a position between them before.

Runs of 12 words have common prefixes of 6 and more. A cheap pass over hashes of six words leaves out documents in which no word begins a long enough stretch of
repeated sixes; for all others words are numbered by their bytes, so nothing rests on hashes.

Defined results: words are runs of anything but space and 0x09-0x0D, as they are; null and empty texts have no words and no runs; texts of any length are taken
whole, each by one task; the longest run of a document is its main one, ties to the smaller start, then period; rows keep their multiplicity, null ids included;
columns other than doc_id and text are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import mixed
from .words import Words, gathered

SHORTEST = 12
#: Words that the common prefix of two places of a run has at least.
GRAM = SHORTEST // 2
Run = tuple[int, int, int]  # start, length, period


def _suspects(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Numbers of the texts that may hold runs: with a word whose six words come again within a distance that the stretch of such words behind it allows."""
    n = len(hashes) - GRAM + 1
    if n < 2:
        return np.empty(0, dtype=np.int64)
    inside = text[:n] == text[GRAM - 1 :]
    grams = mixed(text[:n].astype(np.uint64) + np.uint64(1))
    for k in range(GRAM):
        grams = mixed(grams + hashes[k : n + k])
    at = np.flatnonzero(inside)
    at = at[np.argsort(grams[at], kind="stable")]
    same = grams[at[1:]] == grams[at[:-1]]
    ahead = np.zeros(n, dtype=np.int64)  # distance to the next place with the same six words, 0 if there is none
    ahead[at[:-1][same]] = (at[1:] - at[:-1])[same]
    ends = np.append(np.flatnonzero(ahead == 0), n)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    return np.unique(text[:n][(ahead > 0) & (ahead <= left + GRAM - 1)])


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal for equal words of one text alone, with a number of its own behind each text; and the first place of each text."""
    out, first, base = [], [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        first.append(sum(map(len, out)))
        out.append(np.array([base + known.setdefault(w, len(known)) for w in words] + [0], dtype=np.int64))
        base += len(known) + 1
        out[-1][-1] = base - 1
    pad = base + np.arange(GRAM)
    return np.concatenate([*out, pad]), np.array(first, dtype=np.int64)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of pairs, in their order."""
    return np.unique(left << 32 | right, return_inverse=True)[1].astype(np.int64)


def _suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order, and the common prefix of each with the one before (0 where it is shorter than six words)."""
    n = len(symbols) - GRAM + 1
    two = _pairs(symbols[:-1], symbols[1:])
    four = _pairs(two[:-2], two[2:])
    grams = _pairs(four[:n], two[4 : n + 4])
    order = np.argsort(grams, kind="stable")
    starts = np.ones(n, dtype=bool)
    starts[1:] = grams[order[1:]] != grams[order[:-1]]
    # the rank of a place is that of the first one of its class, in order of the words
    rank = np.arange(len(symbols), dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    levels, size, first = [rank], GRAM, starts.copy()
    while not starts.all():
        tied = ~starts
        tied[:-1] |= ~starts[1:]
        at = np.flatnonzero(tied)
        here, group = order[at], rank[order[at]]
        behind = rank[here + size]
        new = np.lexsort((behind, group))
        order[at], group, behind = here[new], group[new], behind[new]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])
        starts[at] = fresh
        rank = rank.copy()
        rank[order[at]] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        levels.append(rank)
        size *= 2
    prefix = np.zeros(n, dtype=np.int64)
    pair = np.flatnonzero(~first)
    x, y = order[pair - 1], order[pair]
    shared = np.zeros(len(pair), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared += np.where(levels[k][x + shared] == levels[k][y + shared], GRAM << k, 0)
    live = np.arange(len(pair))
    while len(live := live[symbols[x[live] + shared[live]] == symbols[y[live] + shared[live]]]):
        shared[live] += 1
    prefix[pair] = shared
    return order, prefix


def _united(symbols: np.ndarray, order: np.ndarray, prefix: np.ndarray) -> set[Run]:
    """Runs (first place, length, period): unite neighbours in suffix order from the longest common prefix down, and look at places that become neighbours."""
    turn = np.argsort(-prefix, kind="stable")
    turn = turn[prefix[turn] >= GRAM]
    used = np.zeros(len(order), dtype=bool)
    used[turn] = used[turn - 1] = True
    members = {k: [p] for k, p in zip(np.flatnonzero(used).tolist(), order[used].tolist(), strict=True)}
    parent = {k: k for k in members}
    word = symbols.tolist()
    out: set[Run] = set()

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, shared in zip(turn.tolist(), prefix[turn].tolist(), strict=True):
        large, small = root(k - 1), root(k)
        if len(members[large]) < len(members[small]):
            large, small = small, large
        parent[small] = large
        into = members[large]
        for p in members[small]:
            at = bisect(into, p)
            for i, j in ((into[at - 1], p) if at else (0, 0), (p, into[at]) if at < len(into) else (0, 0)):
                period = j - i
                # neighbours from before, and stretches that run on, differ here
                if 0 < period <= shared and period + shared >= SHORTEST and word[i + shared] != word[j + shared] and word[i - 1] != word[j - 1]:
                    out.add((i, period + shared, period))
            into.insert(at, p)
        del members[small]
    return out


def runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """All runs of each text, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    if not any(map(len, texts)):
        return out
    symbols, first = _numbered(texts)
    order, prefix = _suffixes(symbols)
    for start, length, period in sorted(_united(symbols, order, prefix)):
        k = int(np.searchsorted(first, start, side="right")) - 1
        out[k].append((start - int(first[k]), length, period))
    return out


def collapsed_words(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def of_texts(bodies: list[bytes | None]) -> list[tuple[list[bytes], list[Run]]]:
    """Words and runs of each text."""
    split = [(b or b"").split() for b in bodies]
    words = Words(bodies, fold=False)
    found: list[list[Run]] = [[] for _ in bodies]
    suspects = _suspects(words.hashes, words.text, len(bodies)).tolist()
    for k, own in zip(suspects, runs([split[k] for k in suspects]), strict=True):
        found[k] = own
    return list(zip(split, found, strict=True))


def damaged(docs: DataFrame) -> DataFrame:
    """doc_id and text; one in ten documents, by a hash of its id, repeats a piece from some word on (as words with single spaces). Null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.greatest(F.size("w"), F.lit(0)))
    own = own.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int"))).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    piece = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    new = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(piece, F.lit(1), F.col("n") - F.col("a"))), " ")
    return own.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))


def _mapped(docs: DataFrame, columns: list[tuple[str, pa.DataType]], fields: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1, 2000, 2**21):
            rows = [row(*x) for x in of_texts(batch.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), columns, strict=True))], names=["doc_id", *(n for n, _ in columns)])
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, text of the words that stay, and runs (start, length, period in words), by start, then period; a row per row of docs."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def row(words: list[bytes], found: list[Run]) -> tuple:
        return b" ".join(collapsed_words(words, found)).decode(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]

    return _mapped(docs, [("text", pa.string()), ("runs", kind)], "doc_id long, text string, runs array<struct<start: bigint, length: bigint, period: bigint>>", row)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest one (start, length, period, exponent in thousandths; nulls if none) and digests of all runs and of the words that stay."""

    def row(words: list[bytes], found: list[Run]) -> tuple:
        start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
        milli = None if length is None else 1000 * length // period
        return len(found), start, length, period, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed_words(words, found))).hexdigest()

    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    digests = ["runs_sha256", "collapsed_sha256"]
    fields = ", ".join(["doc_id long", *(f"{c} long" for c in numbers), *(f"{c} string" for c in digests)])
    return _mapped(docs, [*((c, pa.int64()) for c in numbers), *((c, pa.string()) for c in digests)], fields, row)
