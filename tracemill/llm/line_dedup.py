"""Line dedup: exact set-similarity join of lines, later matches removed.

A line's set is its distinct words (A-Z count as a-z). A line goes if an earlier one, in the order of (doc_id, line number),
has a set with Jaccard similarity of 0.8 or more; whether that earlier line goes itself doesn't matter.

1. One pass over the texts gives each line the key of its set, and counts in how many lines words occur, in a fixed number of
   hashed counters of 32 MB in all (a word's rarity is the count of its counter; any fixed order of words keeps the join exact).
   Tasks send the counters they used; sums run over one piece of 2**16 counters at a time.
2. Lines with equal sets are one class. All but its first line go.
3. A second pass orders each line's words by rarity and emits its prefix: of n words the first n - ceil(0.8 n) + 1, with their
   positions. Two sets that match share a word in their prefixes, and at the first such word the rest of both must still reach
   the overlap needed (positional filter); sizes must be within 0.8 (length filter).
4. A further filter compares parities of words in 128 bits: sets that match differ in few words, so their parities in few bits.
   In each word's bucket all pairs go through the filters, by rising size, so that a class meets only those that length and position allow; what they leave is
   verified on full sets.
5. Buckets of over 512 classes with over 32 such pairs a class are cut into parts by size, with full sets of the classes in pairs, and parts whose sizes are near enough meet in pairs: intersections of all their classes are products of
   two 0/1 matrices, so that a large group of near copies is counted where it is compared, and its pairs aren't listed. A
   pair counts in the bucket of the first word that both sets have, there alone.
6. Each match is a link of both its classes: links are counted on both sides, and the later line of a link goes.

Sets too small to be within the threshold of another (up to 3 words at 0.8) match equal sets only. Class keys and words are 64-bit hashes.

Defined results: lines without words stay and match nothing; null texts stay null and have no lines; rows with a null doc_id stay as they are; rows with the same
doc_id count as one document, whose lines at the same place aren't later than each other; texts and lines of any length are taken whole; an empty table gives no
rows; columns other than doc_id and text are passed on by ``deduplicated``, whatever their names (``n_chars`` is recounted), and ignored by ``removed_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, shingles, words

#: Counters of lines that hold a word, by the first bits of its hash; the shared table has the logarithms of the counts.
BITS = 24
_SHIFT = np.uint64(64 - BITS)
_PIECE = 2**16
_BLOCK, _COMPARED, _ELEMENTS = 50_000, 512, 2**16


class Lines:
    """The lines with words of a batch of texts, as flat arrays of the distinct words of each, by rarity or in any fixed order."""

    def __init__(self, bodies: list[bytes | None], rarity: np.ndarray | None = None, wanted: list[set[int]] | None = None) -> None:
        found = words.Words(bodies)
        new = np.ones(len(found.hashes), dtype=bool)
        new[1:] = (found.text[1:] != found.text[:-1]) | (found.line[1:] != found.line[:-1])
        at = np.flatnonzero(new)
        owner, number, line, hashes = found.text[at], found.line[at], np.cumsum(new) - 1, found.hashes
        if wanted is not None and len(at):
            keep = np.array([n in wanted[o] for o, n in zip(owner.tolist(), number.tolist(), strict=True)], dtype=bool)
            of_word = keep[line]
            line, hashes, owner, number = (np.cumsum(keep) - 1)[line[of_word]], hashes[of_word], owner[keep], number[keep]
        self.owner, self.number = owner.astype(np.int64), number.astype(np.int32)
        rank = np.zeros(len(hashes), dtype=np.int64) if rarity is None else rarity[hashes >> _SHIFT].astype(np.int64)
        order = self._order(line, rank, hashes)
        line, hashes = line[order], hashes[order]
        distinct = np.ones(len(hashes), dtype=bool)
        distinct[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
        self.line, self.words = line[distinct], hashes[distinct]
        self.sizes = np.bincount(self.line, minlength=len(self.owner)).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        sums = np.add.reduceat(shingles.mixed(self.words), self.starts) if len(self.sizes) else np.empty(0, dtype=np.uint64)
        self.classes = shingles.mixed(sums + self.sizes.astype(np.uint64)).view(np.int64)
        bits = np.left_shift(np.uint64(1), self.words & np.uint64(63))
        upper = (self.words & np.uint64(64)) > 0
        # parities of words by 7 bits of their hashes: two sets differ in at least as many words as their parities in bits
        none = np.empty(0, dtype=np.int64)
        self.low, self.high = (np.bitwise_xor.reduceat(np.where(part, bits, np.uint64(0)), self.starts).view(np.int64) if len(self.sizes) else none for part in (~upper, upper))

    @staticmethod
    def _order(line: np.ndarray, rank: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Order by (line, rank, hash): by one packed number, if lines are few enough and no two different words share it."""
        if len(line) and line[-1] < 2**14:
            packed = (line.astype(np.uint64) << np.uint64(50)) | (rank.astype(np.uint64) << np.uint64(34)) | (hashes >> np.uint64(30))
            order = np.argsort(packed)
            packed, sorted_hashes = packed[order], hashes[order]
            if not ((packed[1:] == packed[:-1]) & (sorted_hashes[1:] != sorted_hashes[:-1])).any():
                return order
        return np.lexsort((hashes, rank, line))


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("body"))


def _add(counts: np.ndarray, counters: np.ndarray) -> None:
    """Raise 16-bit counts by how often each counter occurs; they stop at 65,535."""
    used, times = np.unique(counters, return_counts=True)
    counts[used] = np.minimum(counts[used] + times, 65_535)


def _keyed(bodies: DataFrame) -> DataFrame:
    """Lines (doc_id, line, class, n), and the counters that a task has used as rows with a payload (line: of which piece).

    A payload holds places within the piece and then counts, 16 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2**BITS, dtype=np.uint16)
        names = ["doc_id", "line", "class", "n", "payload"]
        for batch in common.slices(batches, 1):
            found = Lines(batch.column(1).to_pylist())
            _add(counts, (found.words >> _SHIFT).astype(np.int64))
            doc_id = batch.column(0).take(pa.array(found.owner))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(found.number), pa.array(found.classes), pa.array(found.sizes), pa.nulls(len(found.sizes), pa.binary())], names=names)
        pieces = counts.reshape(-1, _PIECE)
        for first in range(0, len(pieces), 16):
            used = {k: np.flatnonzero(pieces[k]) for k in range(first, min(first + 16, len(pieces)))}
            payloads = {k: places.astype("<u2").tobytes() + pieces[k][places].astype("<u2").tobytes() for k, places in used.items() if len(places)}
            empty = pa.nulls(len(payloads), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, pa.array(list(payloads), pa.int32()), empty, empty, pa.array(list(payloads.values()), pa.binary())], names=names)
        del counts, pieces
        common.release()

    return bodies.mapInArrow(run, "doc_id long, line int, class long, n long, payload binary")


def _rarity(keyed: DataFrame) -> np.ndarray:
    """2,000 times the binary logarithm of each counter over all tasks (0 for one line): a table of 32 MB, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = None, np.zeros(_PIECE, dtype=np.int64)

        def closed() -> pa.RecordBatch:
            ranks = np.minimum(2000 * np.log2(np.maximum(total, 1)), 65535).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([ranks], pa.binary())], names=["line", "payload"])

        for batch in batches:
            for k, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != piece:
                    if piece is not None:
                        yield closed()
                    piece, total[:] = k, 0
                places, counts = np.frombuffer(payload.as_buffer(), dtype="<u2").reshape(2, -1)
                total[places] += counts
        if piece is not None:
            yield closed()

    payloads = keyed.filter("payload IS NOT NULL").select("line", "payload")
    n = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = payloads.repartition(min(n, 2**BITS // _PIECE), "line").sortWithinPartitions("line").mapInArrow(add, "line int, payload binary").collect()
    table = np.zeros(2**BITS, dtype=np.uint16)
    for row in rows:
        table[row["line"] * _PIECE : (row["line"] + 1) * _PIECE] = np.frombuffer(row["payload"], dtype="<u2")
    return table


def _prefixes(bodies: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """word, class, low, high, n, place for the prefix of each line that can match another set; a class once per task.

    Of two different sets, the smaller has at most all but one word of the larger. Words of a counter at one line are left out: they can't be shared.
    """
    shared = bodies.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.slices(batches, 1):
            found = Lines(batch.column(1).to_pylist(), shared.value)
            classes, index = np.unique(found.classes, return_index=True)
            if len(seen) > 200_000:
                seen.clear()
            fresh = np.zeros(len(found.sizes), dtype=bool)
            fresh[[k for c, k in zip(classes.tolist(), index.tolist(), strict=True) if c not in seen]] = True
            seen.update(classes.tolist())
            n = found.sizes
            length = np.where(fresh & (100 * n >= percent * (n + 1)), n - (percent * n + 99) // 100 + 1, 0)
            line = np.repeat(np.arange(len(n)), length)
            place = np.arange(len(line)) - np.repeat(np.cumsum(length) - length, length)
            word = found.words[found.starts[line] + place] if len(line) else np.empty(0, dtype=np.uint64)
            common_words = shared.value[word >> _SHIFT] > 0
            line, place, word = line[common_words], place[common_words], word[common_words]
            columns = (word.view(np.int64), found.classes[line], found.low[line], found.high[line], n[line].astype(np.int32), place.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "class", "low", "high", "n", "place"])
        common.release()

    return bodies.mapInArrow(run, "word long, class long, low long, high long, n int, place int")


def _windows(percent: int, starts: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (sizes rising within the buckets that begin at ``starts``) that have later ones to meet in their bucket, and how many: the next so many.

    Of a pair, the smaller set bounds the larger one's size twice: by the length filter, and as its words from ``place`` on must reach the overlap needed.
    """
    bucket = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
    most = np.minimum(100 * n // percent, (100 + percent) * (n - place) // percent - n)
    a = np.flatnonzero(most >= n)
    width = int(n.max()) * 3 + 1 if len(n) else 1
    ends = np.searchsorted(bucket * width + n, bucket[a] * width + np.minimum(most[a], width - 1), side="right")
    return a, np.maximum(ends - a - 1, 0)


def _possible(percent: int, low: np.ndarray, high: np.ndarray, n: np.ndarray, place: np.ndarray, a: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each entry of ``a`` and the next ``times`` after it that pass the positional filter of the later one and the parity filter, some 2**20 looked at at a time."""
    a, times = a[times > 0], times[times > 0]
    ends, first = np.cumsum(times), 0
    while first < len(a):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + 2**20, side="right")))
        x = np.repeat(a[first:last], times[first:last])
        y = x + 1 + np.arange(len(x)) - np.repeat(ends[first:last] - times[first:last] - before, times[first:last])
        good = (100 + percent) * (n[y] - place[y]) >= percent * (n[x] + n[y])
        x, y = x[good], y[good]
        differ = np.bitwise_count((low[x] ^ low[y]).view(np.uint64)).astype(np.int64) + np.bitwise_count((high[x] ^ high[y]).view(np.uint64))
        good = (100 + percent) * differ <= (100 - percent) * (n[x] + n[y])
        yield x[good], y[good]
        first = last


def _met(entries: DataFrame, percent: int) -> DataFrame:
    """Buckets of entries by word: rows a, b for the pairs of classes that the filters leave.

    Of buckets of over 512 classes where the filters leave over 32 pairs a class, the classes that are left in pairs come back (word, and a the class), to be
    split. Rows come sorted by word; a bucket of more than 50,000 rows goes through in pieces, which may repeat a class, and comes back whole.
    """
    names = ["word", "class", "low", "high", "n", "place"]

    def row(a: np.ndarray, b: np.ndarray | None, word: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if word is None else pa.array(word)], names=["a", "b", "word"])

    def met(rows: list[np.ndarray], hot: int | None) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((rows[1], rows[4], rows[0]))
        rows = [x[order].astype(np.int64) for x in rows]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        word, cls, low, high, n, place = (x[first] for x in rows)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(starts, len(word)))
        whole = np.repeat(sizes, sizes) > _BLOCK
        if hot is not None:
            whole |= word == hot
        if whole.any():
            yield row(cls[whole], None, word[whole])
        x, times = _windows(percent, starts, n, place)
        times[whole[x]] = 0
        pairs = lambda k: _possible(percent, low, high, n, place, x[k], times[k])
        waiting, count = [], 0
        small = np.repeat(sizes <= _COMPARED, sizes)[x]
        for p, q in pairs(small):
            waiting.append((cls[p], cls[q]))
            count += len(p)
            if count > 500_000:
                yield row(*map(np.concatenate, zip(*waiting, strict=True)), None)
                waiting, count = [], 0
        for k in np.flatnonzero(sizes > _COMPARED):
            own, found = [], 0
            met_here = np.zeros(sizes[k], dtype=bool)
            for p, q in pairs(slice(*np.searchsorted(x, (starts[k], starts[k] + sizes[k])))):
                found += len(p)
                if found <= sizes[k] * (_COMPARED // 16):
                    own.append((cls[p], cls[q]))
                met_here[p - starts[k]] = met_here[q - starts[k]] = True
            if found > sizes[k] * (_COMPARED // 16):
                at = starts[k] + np.flatnonzero(met_here)
                yield row(cls[at], None, word[at])
            else:
                waiting += own
                count += found
            if count > 500_000:
                yield row(*map(np.concatenate, zip(*waiting, strict=True)), None)
                waiting, count = [], 0
        if count:
            yield row(*map(np.concatenate, zip(*waiting, strict=True)), None)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        waiting, count = [], 0
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= _BLOCK:
                yield [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in waiting]) for k in range(len(names))]
                waiting, count = [], 0
        if count:
            yield [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in waiting]) for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        hot: int | None = None
        for rows in blocks(batches):
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield from met([x[:cut] for x in rows], hot)
            held = [x[cut:] for x in rows]
            if len(held[0]) > _BLOCK:
                hot = int(held[0][0])
                yield from met(held, hot)
                held = None
        if held is not None and len(held[0]):
            yield from met(held, hot)
        common.release()

    return entries.select(*names).mapInArrow(run, "a long, b long, word long")


def _sets(bodies: DataFrame, lines: DataFrame, rarity: np.ndarray) -> DataFrame:
    """id (class), elements (words, rarest first) of the first lines (id, doc_id, line) given."""
    wanted = common.written_clean(lines.groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "line-places")
    shared = bodies.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 0):
            found = Lines(batch.column(0).to_pylist(), shared.value, wanted=[set(x) for x in batch.column(1).to_pylist()])
            offsets = np.append(found.starts, len(found.words)).astype(np.int32)
            elements = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(found.classes), elements], names=["id", "elements"])
        common.release()

    rows = bodies.join(common.small_side(wanted), "doc_id").select("body", "lines")
    return common.written_clean(rows.mapInArrow(run, "id long, elements array<long>").dropDuplicates(["id"]), "line-sets")


def _bands(sized: DataFrame, percent: int) -> DataFrame:
    """sized(word, n: set size, sets) -> word, n, base, parts, low, high: how sets of a bucket are dealt into parts by size, and which parts they meet.

    Neighbouring sizes make a band of about one part (512 sets or 2**16 elements); a band of more is dealt into ``parts`` parts, numbered from ``base``. Sets
    can match only where the smaller has ``percent`` of the larger one's size at least, so those of a band meet the parts of the bands from ``low`` to ``high`` alone.
    """
    weighed = sized.withColumn("weight", F.col("sets") * F.greatest(F.col("n"), F.lit(_ELEMENTS // _COMPARED)))
    before = lambda order: W.partitionBy("word").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    banded = weighed.withColumn("band", F.floor(F.coalesce(F.sum("weight").over(before("n")), F.lit(0)) / _ELEMENTS).cast("long"))
    bands = banded.groupBy("word", "band").agg(F.ceil(F.sum("weight") / _ELEMENTS).cast("long").alias("parts"), F.min("n").alias("least"), F.max("n").alias("most"))
    bands = bands.withColumn("base", F.coalesce(F.sum("parts").over(before("band")), F.lit(0)))
    others = bands.select("word", *[F.col(c).alias(f"{c}_o") for c in ("base", "parts", "least", "most")])
    near = (F.lit(100) * F.col("most_o") >= F.lit(percent) * F.col("least")) & (F.lit(100) * F.col("most") >= F.lit(percent) * F.col("least_o"))
    reach = bands.join(others, "word").filter(near).groupBy("word", "band", "base", "parts").agg(F.min("base_o").alias("low"), F.max(F.col("base_o") + F.col("parts_o") - 1).alias("high"))
    return banded.select("word", "n", "band").join(reach, ["word", "band"]).drop("band")


def _split(large: DataFrame, lines: DataFrame, sets: DataFrame, ranges: int, percent: int) -> DataFrame:
    """Large buckets (word, class), dealt into parts by size: each with its own part and with every other one whose sets are near enough in size to match."""
    placed = large.join(sets.select(F.col("id").alias("class"), "elements"), "class").join(lines.withColumnRenamed("id", "class"), "class")
    placed = common.written_clean(placed.withColumn("n", F.size("elements").cast("long")), "line-large")
    sized = common.written_clean(placed.groupBy("word", "n").agg(F.count("*").alias("sets")), "line-sizes")
    bands = common.written_clean(_bands(sized, percent), "line-parts")
    dealt = placed.join(common.small_side(bands), ["word", "n"]).withColumn("part", F.col("base") + F.pmod(F.xxhash64("class"), F.col("parts"))).withColumn("other", F.explode(F.sequence("low", "high")))
    pair = dealt.select("word", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).alias("second"), "class", "doc_id", "line", "elements")
    return pair.repartition(ranges, "word", "p", "q").sortWithinPartitions("word", "p", "q")


def _products(row: np.ndarray, column: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many columns each row of ``first`` has in common with each of ``second``, rows being sets of columns."""
    size = max(len(first), len(second)) and int(max(first.max(), second.max())) + 1
    used, column, times = np.unique(column, return_inverse=True, return_counts=True)
    shared = times > 1  # others are in no two sets
    column, row = (np.cumsum(shared) - 1)[column][shared[column]], row[shared[column]]
    out, order = np.zeros((len(first), len(second)), dtype=np.float32), np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for begin in range(0, int(shared.sum()), 4096):
        x, y = np.searchsorted(column, (begin, begin + 4096))
        table = np.zeros((size, 4096), dtype=np.float32)
        table[row[x:y], column[x:y] - begin] = 1
        out += table[first] @ table[second].T
    return out.astype(np.int64)


def _linked(word: int, second: np.ndarray, at: np.ndarray, elements: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of two parts of a bucket: how many of the other part match it (all but itself, within one part), and whether one that is seen before it does.

    ``at`` ranks the sets by where they are seen first. A match with a common word before the bucket's own counts in another bucket.
    """
    sizes = np.array([len(x) for x in elements], dtype=np.int64)
    flat, row = np.concatenate(elements), np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - starts[row]
    own = np.full(len(sizes), len(flat), dtype=np.int64)
    own[row[flat == word]] = place[flat == word]
    early = place < own[row]
    a, b = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(sizes)),) * 2
    if not len(a):
        return np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=bool)
    common_words, before = _products(row, flat, a, b), _products(row[early], flat[early], a, b)
    match = (100 * common_words >= percent * (sizes[a][:, None] + sizes[b][None, :] - common_words)) & (before == 0) & (a[:, None] != b[None, :])
    degree, later = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=bool)
    earlier = at[b][None, :] < at[a][:, None]
    degree[a], later[a] = match.sum(axis=1), (match & earlier).any(axis=1)
    if second.any():
        degree[b], later[b] = match.sum(axis=0), (match & (at[a][:, None] < at[b][None, :])).any(axis=0)
    return degree, later


def _counted(dealt: DataFrame, percent: int) -> DataFrame:
    """class, degree, later for classes of large buckets: matches whose first common word is the bucket's."""
    names = ["word", "p", "q", "second", "class", "doc_id", "line", "elements"]

    def counted(rows: pa.Table) -> pa.RecordBatch:
        second, cls, doc_id, line = (rows.column(k).to_numpy() for k in names[3:7])
        if rows.column("p")[0].as_py() != rows.column("q")[0].as_py() and not second.any():  # no class was dealt into the second part
            return pa.RecordBatch.from_arrays([pa.nulls(0, pa.int64()), pa.nulls(0, pa.int64()), pa.nulls(0, pa.bool_())], names=["class", "degree", "later"])
        elements = [np.asarray(x.values) for x in rows.column("elements").combine_chunks()]
        order = np.lexsort((line, doc_id))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (doc_id[order][1:] != doc_id[order][:-1]) | (line[order][1:] != line[order][:-1])
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.cumsum(new)
        degree, later = _linked(rows.column("word")[0].as_py(), second.astype(bool), at, elements, percent)
        used = degree > 0
        return pa.RecordBatch.from_arrays([pa.array(cls[used]), pa.array(degree[used]), pa.array(later[used])], names=["class", "degree", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if held and any(held[0].column(k)[0].as_py() != keys[x, k] for k in range(3)):
                    yield counted(pa.Table.from_batches(held))
                    held = []
                if y > x:
                    held.append(batch.slice(x, y - x))
        if held:
            yield counted(pa.Table.from_batches(held))
        common.release()

    return dealt.select(*names).mapInArrow(run, "class long, degree long, later boolean")


def _matched(met: DataFrame, firsts: DataFrame, bodies: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """Met pairs and large buckets -> class, degree (other classes that match), later (whether one of them is seen before it)."""
    ranges = max(1, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = common.written_clean(met.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    large = common.written_clean(met.filter("b IS NULL").select("word", F.col("a").alias("class")).distinct(), "line-buckets-large")
    used = common.written_clean(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(large.select(F.col("class").alias("id"))).distinct(), "line-ids")
    lines = common.written_clean(firsts.withColumnRenamed("class", "id").join(common.small_side(used), "id").select("id", "first.*"), "line-firsts")
    sets = _sets(bodies, lines, rarity)
    side = lambda s: sets.select(F.col("id").alias(s), F.col("elements").alias(f"e{s}"))
    both = common.salted_join(pairs, side("b"), "b", "a", common.hot_keys(pairs, "b"))
    both = common.salted_join(both, side("a"), "a", "b", common.hot_keys(pairs, "a")).withColumn("common", F.array_intersect("ea", "eb"))
    shared, total = F.size("common").cast("long"), (F.size("ea") + F.size("eb")).cast("long")
    links = both.filter(F.lit(100) * shared >= F.lit(percent) * (total - shared)).select("a", "b", F.element_at("common", 1).alias("word"))
    # those of a large bucket are counted there
    links = common.written_clean(links.join(common.small_side(common.written_clean(large.select("word").distinct(), "line-words")), "word", "left_anti").select("a", "b"), "line-links")
    at = lambda s: lines.select(F.col("id").alias(s), F.struct("doc_id", "line").alias(f"at_{s}"))
    ordered = links.join(common.small_side(at("a")), "a").join(common.small_side(at("b")), "b")
    sides = ordered.select(F.explode(F.array(*(F.struct(F.col(x).alias("class"), F.lit(1).cast("long").alias("degree"), (F.col(f"at_{x}") > F.col(f"at_{y}")).alias("later")) for x, y in ("ab", "ba")))).alias("s"))
    counted = _counted(_split(large, lines, sets, ranges, percent), percent)
    return sides.select("s.*").union(counted).groupBy("class").agg(F.sum("degree").alias("degree"), F.max("later").alias("later"))


def _judged(lines: DataFrame, judging: DataFrame) -> DataFrame:
    """lines with what judging (j_class, times; written) says of their class. Where judging is large, the lines of hot classes aren't shuffled by their class."""
    own = lambda df, side, how: df.join(side, df["class"] == side["j_class"], how)
    if common.fits(judging):
        return own(lines, F.broadcast(judging), "left")
    # more lines than 1 in 10,000, so there are fewer than 10,000 such classes
    often = F.coalesce(F.col("times"), F.lit(0)) > lines.count() // 10_000
    hot, rest = F.broadcast(judging.filter(often)), judging.filter(~often)
    return own(lines, hot, "inner").unionByName(own(own(lines, hot.select("j_class"), "left_anti"), rest, "left"))


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines (with words), removed (line numbers from 0), n_links, class_id; for documents with such lines.

    n_links sums over the document's lines the number of classes other than their own that match them, earlier or later.
    """
    bodies = _bodies(docs)
    keyed = common.written_clean(_keyed(bodies), "lines")
    rarity = _rarity(keyed)
    lines = keyed.filter("doc_id IS NOT NULL").select("doc_id", "line", "class")
    firsts = common.written_clean(lines.groupBy("class").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("times")), "line-classes")

    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries = _prefixes(bodies, rarity, percent).repartition(ranges, "word").sortWithinPartitions("word")
    met = common.written_clean(_met(entries, percent), "line-buckets")
    links = _matched(met, firsts.select("class", "first"), bodies, rarity, percent)

    # classes of one line without links need no look
    judging = firsts.filter("times > 1").select("class", "first", "times").join(links, "class", "full_outer").withColumnRenamed("class", "j_class")
    joined = _judged(lines, common.written_clean(judging, "line-judging"))
    judged = joined.select(
        "doc_id",
        "line",
        F.coalesce("degree", F.lit(0)).alias("degree"),
        (F.coalesce("later", F.lit(False)) | F.coalesce(F.struct("doc_id", "line") > F.col("first"), F.lit(False))).alias("gone"),
        F.coalesce("first.doc_id", "doc_id").alias("class_doc"),
    )
    return judged.groupBy("doc_id").agg(
        F.countDistinct("line").cast("long").alias("n_lines"),
        F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("line")))).alias("removed"),
        F.sum("degree").cast("long").alias("n_links"),
        F.min("class_doc").alias("class_id"),
    )


def deduplicated(docs: DataFrame, percent: int = 80, drop_emptied: bool = True) -> DataFrame:
    """docs with the removed lines cut from ``text`` (and ``n_chars``, if there, recounted).

    A document that had words and has none left is dropped, unless ``drop_emptied`` is false: all it said is in earlier documents.
    """
    cut = common.written_clean(removed_lines(docs, percent).filter(F.size("removed") > 0).select(F.col("doc_id").alias("cut_id"), F.col("removed").alias("cut_lines"), (F.col("n_lines") == F.size("removed")).alias("cut_all")), "removed-lines")
    if drop_emptied:
        emptied = common.written_clean(cut.filter("cut_all").select("cut_id"), "emptied")
        docs = docs.join(common.small_side(emptied), docs["doc_id"].cast("long") == emptied["cut_id"], "left_anti")
        cut = cut.filter("NOT cut_all")
    joined = docs.join(common.small_side(cut), docs["doc_id"].cast("long") == cut["cut_id"], "left")
    names, text_at, chars_at = docs.columns, docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_at):
            columns = batch.columns[:-1]
            texts, sizes = columns[text_at].to_pylist(), None if chars_at is None else columns[chars_at].to_pylist()
            for row, cut_lines in enumerate(batch.columns[-1].to_pylist()):
                if cut_lines and texts[row] is not None:
                    gone = set(cut_lines)
                    texts[row] = "\n".join(x for k, x in enumerate(texts[row].split("\n")) if k not in gone)
                    if sizes is not None:
                        sizes[row] = len(texts[row])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if sizes is not None:
                columns[chars_at] = pa.array(sizes, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        common.release()

    # by place: the columns of docs may have any names
    return joined.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(names)], cut["cut_lines"].alias("gone")).mapInArrow(run, docs.schema)


#: op2_line_dedup, by comparing all sets that share a word and are near enough in size.
LINES_SQL = r"""
WITH t AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM t
), s AS (
  SELECT doc_id, n, doc_id * 1000000 + n AS place,
         list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w FROM l
), c AS (
  SELECT row_number() OVER () AS id, w, len(w) AS k, min(place) AS first FROM s WHERE len(w) > 0 GROUP BY w
), x AS (
  SELECT id, k, unnest(w) AS word FROM c
), p AS (
  SELECT a.id AS a, b.id AS b, a.k AS ka, b.k AS kb, count(*) AS both_have FROM x a JOIN x b ON a.word = b.word AND a.id < b.id AND 100 * least(a.k, b.k) >= 80 * greatest(a.k, b.k) GROUP BY ALL
), e AS (
  SELECT a, b FROM p WHERE 100 * both_have >= 80 * (ka + kb - both_have) UNION ALL SELECT b, a FROM p WHERE 100 * both_have >= 80 * (ka + kb - both_have)
), d AS (
  SELECT e.a AS id, count(*) AS degree, min(c.first) AS earliest FROM e JOIN c ON c.id = e.b GROUP BY 1
), j AS (
  SELECT s.doc_id, s.n, coalesce(degree, 0) AS degree, s.place > c.first OR coalesce(d.earliest < c.first, false) AS gone, c.first // 1000000 AS class_doc FROM s JOIN c ON c.w = s.w LEFT JOIN d ON d.id = c.id
), g AS (
  SELECT doc_id, min(class_doc) AS class_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sum(degree)::BIGINT AS n_links, string_agg(n, ',' ORDER BY n) FILTER (gone) AS removed FROM j GROUP BY 1
)
SELECT doc_id, coalesce(class_id, doc_id)::BIGINT AS class_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(removed, '') AS removed
FROM (SELECT doc_id FROM documents) LEFT JOIN g USING (doc_id)
"""
