"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

1. One pass over the texts gives each document its set size, a 128-bit key of its shingle set and its band keys.
2. Documents with equal sets are one class; its smallest doc_id stands for it from here on.
3. Classes that share a band key are candidates. Pairs of a bucket are not listed: its hub (the class that shares most
   band keys) is verified against each other member first, on full sets, and what links becomes one component.
4. Classes of buckets that still hold several components are joined across components by an exact prefix filter: with a
   set's shingles ordered by rarity, two sets that link share one among the first n - ceil(0.8 n) + 1 of each, and at the
   first such one the rest of both still reaches the overlap needed. All pairs that the filter leaves are verified. (Rarity is
   counted in a fixed number of hashed counters; any fixed order keeps the filter exact.)
5. Components of all verified links; members of a class follow it.

Bands of 5 rows, 40 of them: a pair at the threshold of 0.8 goes unseen with probability (1 - 0.8**5)**40 = 1.3e-7.

Defined results: null or wordless texts have an empty set and are linked with nothing; a text of fewer words than
the width is one shingle; rows with the same doc_id are one vertex, so that all their texts are in one component; texts of any length are taken whole; a row with a null doc_id is kept and linked with
nothing (component null); an empty table gives no rows; extra columns, whatever their names, are ignored by ``near_duplicates`` and passed on by
``deduplicated``, which keeps all rows of a doc_id that stands for its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components, shingles

ROWS, BANDS = 5, 40
COUNTERS = 2**18
_SHIFT = np.uint64(64 - 18)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (null for empty sets), keys."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shingles.WordNumbers()
        for batch in batches:
            sizes, k1, k2, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles.shingle_set(text, width, numbers)
                sizes.append(len(found))
                a, b = shingles.set_key(found) if len(found) else (None, None)
                k1.append(a)
                k2.append(b)
                keys.append(shingles.bands(shingles.sketch(found, ROWS * BANDS), ROWS) if len(found) else np.empty(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "k1", "k2", "keys"],
            )
        numbers.clear()
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("body")).mapInArrow(run, schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """id, elements (sorted) of docs(id, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shingles.WordNumbers()
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                found = [shingles.shingle_set(t, width, numbers).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "elements"])
        numbers.clear()
        common.release()

    return docs.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("elements", T.ArrayType(T.LongType()))]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; written) with 100 * intersection >= percent * union on full sets. The pairs of an id with very many are dealt over many tasks."""
    with_b = common.salted_join(pairs, sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b", "a", common.hot_keys(pairs, "b"))
    both = common.salted_join(with_b, sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a", "b", common.hot_keys(pairs, "a"))
    counted = both.select("a", "b", F.size(F.array_intersect("ea", "eb")).cast("long").alias("common"), (F.size("ea") + F.size("eb")).cast("long").alias("total"))
    return counted.filter(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("total") - F.col("common"))).select("a", "b")


def _rarity(sets: DataFrame) -> np.ndarray:
    """How often elements occur in sets(elements), in hashed counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts += np.bincount((flat >> _SHIFT).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["counter", "n"])
        common.release()

    table = sets.select("elements").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[table["counter"].to_numpy(dtype=np.int64)] = table["n"].to_numpy(dtype=np.int64)
    return out


def _prefixes(sets: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """element, id, component, n, place: the rarest n - ceil(percent n / 100) + 1 elements of each set, in order."""
    shared = sets.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, ids, components, sizes, places = [], [], [], [], []
            for key, component, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
                n = len(own)
                head = own[np.lexsort((own, shared.value[own >> _SHIFT]))[: n - (percent * n + 99) // 100 + 1]]
                elements.append(head.view(np.int64))
                ids.append(np.full(len(head), key))
                components.append(np.full(len(head), component))
                sizes.append(np.full(len(head), n))
                places.append(np.arange(len(head)))
            if ids:
                columns = [np.concatenate(x).astype(np.int64) for x in (elements, ids, components, sizes, places)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["element", "id", "component", "n", "place"])
        common.release()

    return sets.select("id", "component", "elements").mapInArrow(run, "element long, id long, component long, n long, place long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for each row of docs(doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = common.written(_sketched(texts, width), "sketches")
    filled = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = common.written(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.min_by(F.struct("n_shingles", "keys"), "doc_id").alias("x")), "classes")
    entries = classes.select(F.col("class_id").alias("id"), F.col("x.n_shingles").alias("n"), F.explode("x.keys").alias("key"))

    # buckets of two classes or more; a class's popularity is the sum of its buckets' sizes
    sizes = entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    entries = common.written(entries.join(sizes, "key"), "buckets")
    popularity = entries.groupBy("id").agg(F.sum("members").alias("popularity"), F.max("n").alias("n"))
    popular = entries.join(popularity.select("id", "popularity"), "id")
    hubs = popular.groupBy("key").agg(F.max_by("id", F.struct("popularity", -F.col("id"))).alias("hub"))
    stars = entries.select("key", "id", "n").join(hubs, "key").filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()

    wanted = common.written(popularity.select("id"), "wanted")
    bodies = texts.withColumnRenamed("doc_id", "id").join(common.small_side(wanted), "id", "left_semi").select("id", F.col("text").cast("binary").alias("body"))
    sets = common.written(_sets(bodies, width).filter(F.size("elements") > 0), "sets")
    star_links = common.written(_verified(common.written(stars, "stars"), sets, percent), "star-links")
    # rows with the same doc_id and different texts: their classes are linked by the id
    members = filled.select("doc_id", F.col("k1").alias("m1"), F.col("k2").alias("m2"))
    of_doc = members.join(classes.select("k1", "k2", "class_id"), (F.col("m1") == F.col("k1")) & (F.col("m2") == F.col("k2"))).select("doc_id", "class_id")
    lowest = of_doc.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("high")).filter("a < high").select("doc_id", "a")
    lowest = common.written(lowest, "repeated-ids")
    same_id = of_doc.join(common.small_side(lowest), "doc_id").filter("class_id != a").select("a", F.col("class_id").alias("b")).distinct()
    star_links = star_links.union(common.written(same_id, "same-id"))
    found = components.components(star_links)

    # what is left: classes of buckets that hold several components, joined by the rarest shingles of their sets
    labelled = entries.select("key", "id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    open_ids = common.written(labelled.join(open_keys, "key", "left_semi").select("id", "component").distinct(), "open")
    open_sets = sets.join(common.small_side(open_ids), "id")
    heads = _prefixes(open_sets, _rarity(open_sets), percent)
    mixed = heads.groupBy("element").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("element")
    heads = common.written(heads.join(mixed, "element", "left_semi"), "prefixes")
    left, right = (heads.select("element", *[F.col(c).alias(f"{c}{s}") for c in ("id", "component", "n", "place")]) for s in "12")
    reach = 1 + F.least(F.col("n1") - F.col("place1") - 1, F.col("n2") - F.col("place2") - 1)
    pairs = left.join(
        right,
        (left["element"] == right["element"])
        & (F.col("id1") < F.col("id2"))
        & (F.col("component1") != F.col("component2"))
        & (F.lit(100) * F.least("n1", "n2") >= F.lit(percent) * F.greatest("n1", "n2"))
        & (F.lit(100 + percent) * reach >= F.lit(percent) * (F.col("n1") + F.col("n2"))),
    )
    pairs = pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()
    more = common.written(_verified(common.written(pairs, "prefix-pairs"), sets, percent), "links")
    final = components.components(star_links.union(more))

    members = sketched.select("doc_id", "n_shingles", F.col("k1").alias("m1"), F.col("k2").alias("m2"))
    of_class = classes.select("k1", "k2", "class_id").join(final.withColumnRenamed("id", "class_id"), "class_id", "left")
    joined = members.join(of_class, (F.col("m1") == F.col("k1")) & (F.col("m2") == F.col("k2")), "left")
    component = F.coalesce("component", "class_id", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id")
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id stands for its component, columns unchanged."""
    gone = near_duplicates(docs, width, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
    gone = common.written(gone, "near-duplicates")
    return docs.join(common.small_side(gone), docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


#: near_duplicates of width 4 and 80 percent, by comparing all classes that share a shingle.
NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3]))) END AS shingles FROM d
), k AS (
  SELECT doc_id, len(shingles) AS n, shingles, CASE WHEN len(shingles) > 0 THEN min(doc_id) OVER (PARTITION BY shingles) ELSE doc_id END AS class_id FROM s
), c AS (
  SELECT class_id AS id, n, unnest(shingles) AS shingle FROM k WHERE doc_id = class_id
), p AS (
  SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS both_have FROM c a JOIN c b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 100 * both_have >= 80 * (na + nb - both_have)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT DISTINCT class_id AS id, class_id AS root FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id
), m AS (
  SELECT id, min(root) AS component_id FROM r GROUP BY 1
)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept, class_id FROM k JOIN m ON m.id = k.class_id
"""
