"""Benchmark decontamination: suffix arrays over training shards, searched for every suffix of the test items.

A shard is a slice of documents of some megabytes, read by one task. All its word suffixes are sorted (by three words at once, then by doubled prefixes, ties only,
as deep as a window); a binary search over them finds, for each suffix of each item that begins a window, the range of suffixes that share the window.
Places on one diagonal of item and document join into the longest verbatim matches with their locations; documents with any are contaminated.

The items come to the tasks in blocks of at most ``block_words`` words by a broadcast each; every block passes over all documents in one chain of maps,
so the benchmark may be of any size, its items are never capped, and documents are never shuffled. Words are 64-bit hashes; every match is checked by second ones.

Defined results: words are runs of ASCII letters, digits and any other characters beyond ASCII, A-Z as a-z; null and empty texts have no words and no hits; an
item of fewer words than a window is one window, one without words none; rows that share an item_id are one item, null ids count as an empty id; documents of
any length are searched whole (one longer than a shard is a shard); rows keep their multiplicity, null ids included; columns other than doc_id and text, or
item_id and text, are left out, whatever their names; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Words, gathered

WINDOW = 10
#: Bytes of a text that is cut into words by blanks: all ASCII but letters and digits is a blank, A-Z are a-z.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


class Items(NamedTuple):
    """Words of items one after another; first: where each item begins (one more than items)."""

    ids: list[str]
    first: np.ndarray
    hashes: np.ndarray
    checks: np.ndarray


def _words(bodies: list[bytes | None]) -> Words:
    return Words([None if b is None else b.translate(_PLAIN) for b in bodies], fold=False, checks=True)


def _items(rows: list[tuple[str, str | None]]) -> Items:
    words = _words([None if t is None else t.encode() for _, t in rows])
    first = np.concatenate([[0], np.cumsum(np.bincount(words.text, minlength=len(rows)))]).astype(np.int64)
    return Items([i for i, _ in rows], first, words.hashes, words.checks)


class Suffixes:
    """The suffixes of a shard's words in order of their first ``depth`` words (of their hashes); a suffix ends with its document."""

    def __init__(self, hashes: np.ndarray, text: np.ndarray, depth: int) -> None:
        n = len(hashes)
        self.known, inverse = np.unique(hashes, return_inverse=True)
        # a slot after each document ends it: 0 sorts first and equals nothing in an item
        self.slot = np.arange(n) + text
        size = n + (int(text[-1]) + 1 if n else 0)
        self.symbols = np.zeros(size + 3, dtype=np.int64)
        self.symbols[self.slot] = inverse + 1
        self.word = np.zeros(size, dtype=np.int64)
        self.word[self.slot] = np.arange(n)
        self.bits = max(1, int(len(self.known)).bit_length())
        self.wide = max(1, min(3, 63 // self.bits))
        keys = self._packed(self.symbols, self.slot)
        order = np.argsort(keys, kind="stable")
        self.order, self.keys = self.slot[order], keys[order]
        done = self.wide
        rank = np.zeros(size + 3, dtype=np.int64)
        starts = np.ones(n, dtype=bool)
        starts[1:] = self.keys[1:] != self.keys[:-1]
        while done < depth and n:
            place = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
            # a place with an end within `done` words ties with its like for good, which no search minds
            rank[:] = 0
            rank[self.order] = place + 1
            tied = ~starts
            tied[:-1] |= ~starts[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            here = self.order[at]
            after = rank[np.minimum(here + done, size)]
            new = np.lexsort((after, place[at]))
            self.order[at] = here[new]
            group, after = place[at][new], after[new]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
            starts[at] = fresh
            done *= 2

    def _packed(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first words of suffixes in one number; nothing counts behind an end."""
        out, live = np.zeros(len(at), dtype=np.int64), np.ones(len(at), dtype=bool)
        for k in range(self.wide):
            own = np.where(live, symbols[at + k], 0)
            live = own > 0
            out = out << self.bits | own
        return out

    def search(self, pattern: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last place of the suffixes that begin with the words at .. at + size of ``pattern`` (symbols, none of them 0)."""
        head = np.zeros(len(at), dtype=np.int64)
        for k in range(self.wide):
            own = np.where(k < size, pattern[np.minimum(at + k, len(pattern) - 1)], 0)
            head = head << self.bits | own
        room = (np.int64(1) << self.bits * np.maximum(self.wide - size, 0)) - 1
        low = np.searchsorted(self.keys, head, side="left")
        high = np.searchsorted(self.keys, head + room, side="right")
        out = []
        for upper in (False, True):
            lo, hi = low.copy(), high.copy()
            live = np.flatnonzero((lo < hi) & (size > self.wide))
            while len(live):
                mid = (lo[live] + hi[live]) // 2
                side = self._compared(pattern, at[live], size[live], self.order[mid])
                right = side <= 0 if upper else side < 0
                lo[live[right]] = mid[right] + 1
                hi[live[~right]] = mid[~right]
                live = live[lo[live] < hi[live]]
            out.append(np.where(size > self.wide, lo, high if upper else low))
        return out[0], out[1]

    def _compared(self, pattern: np.ndarray, at: np.ndarray, size: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix is before, begins with or is behind the pattern."""
        side, live, k = np.zeros(len(at), dtype=np.int64), np.arange(len(at)), self.wide
        while len(live):
            live = live[size[live] > k]
            a, b = self.symbols[np.minimum(suffix[live] + k, len(self.symbols) - 1)], pattern[np.minimum(at[live] + k, len(pattern) - 1)]
            side[live] = np.sign(a - b)
            live = live[a == b]
            k += 1
        return side


def matches(bodies: list[bytes | None], items: Items, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Longest verbatim matches: rows of (document, first word, one past the last, item, first word of the item), and the words of each document."""
    words = _words(bodies)
    counts = np.bincount(words.text, minlength=len(bodies)).astype(np.int64)
    sizes = np.diff(items.first)
    starts = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
    item = np.repeat(np.arange(len(sizes)), starts)
    at = gathered(items.first[:-1], starts)
    size = np.minimum(sizes, window)[item]
    if not len(at) or not len(words.hashes):
        return np.zeros((0, 5), dtype=np.int64), counts
    suffixes = Suffixes(words.hashes, words.text, int(size.max()))
    place = np.minimum(np.searchsorted(suffixes.known, items.hashes), len(suffixes.known) - 1)
    pattern = np.where(suffixes.known[place] == items.hashes, place + 1, 0)
    absent = np.concatenate([[0], np.cumsum(pattern == 0)])
    here = np.flatnonzero(absent[at + size] == absent[at])
    at, size, item = at[here], size[here], item[here]
    low, high = suffixes.search(pattern, at, size)
    hit = np.flatnonzero(high > low)
    first = suffixes.word[suffixes.order[gathered(low[hit], (high - low)[hit])]]
    which = np.repeat(hit, (high - low)[hit])
    offset, size, item = at[which], size[which], item[which]
    sure = np.ones(len(which), dtype=bool)  # other words with the same hash
    for k in range(window):
        inside = np.flatnonzero(k < size)
        sure[inside] &= words.checks[first[inside] + k] == items.checks[offset[inside] + k]
    first, offset, size, item = first[sure], offset[sure], size[sure], item[sure]
    # windows that follow one another on a diagonal are one match
    order = np.lexsort((first, first - offset, item))
    first, offset, size, item = first[order], offset[order], size[order], item[order]
    fresh = np.ones(len(first), dtype=bool)
    if len(first):
        text = words.text[first]
        fresh[1:] = (item[1:] != item[:-1]) | (first[1:] - first[:-1] != 1) | (offset[1:] - offset[:-1] != 1) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    end = np.concatenate([begin[1:], [len(first)]]) - 1 if len(begin) else begin
    before = np.cumsum(counts) - counts
    text = words.text[first[begin]] if len(begin) else begin
    found = np.stack([text, first[begin] - before[text], first[end] + size[end] - before[text], item[begin], offset[begin] - items.first[item[begin]]], axis=1) if len(begin) else np.zeros((0, 5), dtype=np.int64)
    return found[np.lexsort((found[:, 4], found[:, 3], found[:, 2], found[:, 1], found[:, 0]))], counts


_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("item_start", pa.int64())]))


def _blocks(benchmark: DataFrame, block_words: int) -> list[list[tuple[str, str | None]]]:
    """Items in blocks of at most so many words (an item longer than that is alone), fetched one block after another."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // (4 * block_words)))
    for k in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        yield [tuple(r) for r in own.collect()]


def located(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 2_000_000, shard_bytes: int = 4 * 2**20) -> DataFrame:
    """doc_id, text, n_words and matches (item_id, start, end and item_start in words), in order of place; a row per row of docs."""
    spark = docs.sparkSession
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"))
    out = out.withColumn("matches", F.lit(None).cast("array<struct<item_id: string, start: bigint, end: bigint, item_start: bigint>>"))
    for rows in _blocks(benchmark, block_words):
        out = _passed(out, spark.sparkContext.broadcast(_items(rows)), window, shard_bytes)
    return out


def _passed(docs: DataFrame, block, window: int, shard_bytes: int) -> DataFrame:
    """docs with the matches of one block of items added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in _shards(batches, shard_bytes):
            bodies = batch.column(1).cast(pa.binary()).to_pylist()
            found, counts = matches(bodies, items, window)
            own: list[list] = [m or [] for m in batch.column(3).to_pylist()]
            for text, start, end, item, offset in found.tolist():
                own[text].append({"item_id": items.ids[item], "start": start, "end": end, "item_start": offset})
            own = [sorted(m, key=lambda x: (x["start"], x["end"])) for m in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(own, _MATCH)], names=["doc_id", "text", "n_words", "matches"])
        common.release()

    return docs.mapInArrow(run, docs.schema)


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many bytes of text: small ones together, large ones cut."""
    held, total = [], 0
    for batch in common.slices(batches, 1, 10**9, size):
        held.append(batch)
        total += batch.column(1).nbytes
        if total >= size:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, total = [], 0
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def _covered(spans: list[dict]) -> int:
    out, reach = 0, 0
    for s in sorted(spans, key=lambda s: s["start"]):
        out += max(0, s["end"] - max(s["start"], reach))
        reach = max(reach, s["end"])
    return out


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for what located() gave, with the longest match in words (0 if none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            ids = [sorted({m["item_id"] for m in row}) for row in rows]
            hits = [_covered(row) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(hits, pa.int64()),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids]),
                    pa.array([h > 0 for h in hits]),
                    pa.array([max((m["end"] - m["start"] for m in row), default=0) for row in rows], pa.int64()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"],
            )

    fields = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"
    return found.select("doc_id", "n_words", "matches").mapInArrow(run, fields)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and text of the documents without a match."""
    return located(docs, benchmark, window).filter(F.size("matches") == 0).select("doc_id", "text")


#: Windows as texts, joined by equality, for every size that windows have. ``longest`` by islands of windows on one diagonal.
LEAK_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS q, coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT q, item_id, least(len(w), 10) AS m, o, array_to_string(w[o + 1 : o + least(len(w), 10)], ' ') AS win FROM (SELECT *, unnest(range(0, greatest(len(w) - 9, 1))) AS o FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, m, p, array_to_string(w[p + 1 : p + m], ' ') AS win FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)
), f AS (
  SELECT r, p, dw.m, q, item_id, o FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win
), runs AS (
  SELECT r, max(p) - min(p) + max(m) AS words FROM (SELECT *, p - row_number() OVER (PARTITION BY r, q, p - o ORDER BY p) AS island FROM f) GROUP BY r, q, p - o, island
), longest AS (
  SELECT r, max(words) AS longest FROM runs GROUP BY r
), hits AS (
  SELECT r, count(DISTINCT h) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS h FROM f) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM f) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r) LEFT JOIN longest USING (r)
"""
