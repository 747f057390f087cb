"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every source gets a target: a weighted share of a total budget, never above ``max_epochs`` times the words it has;
what it can't use is shared again by weight. ``target / size`` then splits in whole epochs, in which every document
is taken once, and a rest. The rest is a weighted sample without replacement: document i gets the key
``-ln(u_i) / w_i`` with u_i uniform by hash of (seed, doc_id) and w_i its quality weight; documents are taken in
ascending order of the key until their words reach the rest. The document that crosses the boundary is taken if
that lands nearer to the rest.

Hot sources: a source's keys are cut into ranges, ``bins`` to each factor of two: whatever the weights, at most 0.255 / bins of a
source's rows are expected in one. Words per range are summed first, with map-side
partial sums; ranges get their base from a prefix sum over that small table; only rows within one range are sorted
together. No task holds a source.

Defined results: null text counts 0 words and such documents follow the epochs like all others; null source is a
source of its own, last in order; texts of any length are counted whole; an empty table gives no rows; rows with the same id tie on the
uniform number, and on the key if size and symbols agree, which size and then nothing breaks: such rows are interchangeable, and ``mixed_documents`` gives
them as many copies in all as the plan does; columns of the input that clash with those made here are left out of the plan and kept in the mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_count(text: Column) -> Column:
    """Characters of ``[#*$%&|<>]``, by the bytes that go when each is taken out."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))) for c in "#*$%&|<>"), F.lit(0)).cast("long")


def uniform(seed: str, doc_id: Column) -> Column:
    """In (0, 1), from 52 bits of md5: (n + 1) / (2**52 + 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52 + 1))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over sources by code point, null last.

    Sources in ascending order of cap / weight are capped one after another; the first k of them are capped where
    the level that the others would get stays under their next cap. That is what sharing excess again and again ends in.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    weighted = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    capped = weighted.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    leveled = capped.withColumn(
        "level",
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # the level of the first source that stays under its cap; if none does, all are capped
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "level"))).over(everything)["level"]
    return leveled.withColumn("final", level).select(
        "source", "source_size", F.when(F.col("final").isNull() | (F.col("final") >= F.col("ratio")), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target")
    )


def mark(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", bins: int = 256) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, source, target, copies, taken; one row per document."""
    return _plan(docs, weights, share, max_epochs, seed, bins).drop("mark")


def _plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", bins: int = 256) -> DataFrame:
    """The same with a mark of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), symbol_count(text).alias("symbols"), mark(F.col("text")).alias("mark"))
    weight = (F.col("size") + 1) / (F.col("size") + 1 + 4 * F.col("symbols"))
    # u ** (1 / w), the original form of the key, falls where -ln(u) / w rises
    keyed = sized.withColumn("key", -F.log(uniform(seed, F.col("doc_id"))) / weight).withColumn("bin", F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * bins).cast("int"))
    keyed = common.written(keyed.select("doc_id", "source", "size", "key", "bin", "mark"), "mix")
    ranges = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sizes = ranges.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    of_source = targets(sizes, weights, share, max_epochs).select(
        F.col("source").alias("t_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    )
    based = ranges.withColumn("base", F.sum("bin_size").over(W.partitionBy("source").orderBy("bin")) - F.col("bin_size"))
    based = based.join(of_source, based["source"].eqNullSafe(of_source["t_source"])).select(
        F.col("source").alias("b_source"), F.col("bin").alias("b_bin"), "base", "source_size", "target", "epochs"
    )
    rows = keyed.withColumn("upto", F.sum("size").over(W.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.join(based, rows["source"].eqNullSafe(based["b_source"]) & (rows["bin"] == based["b_bin"]))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    before = F.col("base") + F.col("upto") - F.col("size")
    extra = F.when((rest > 0) & (before + F.col("size") / 2.0 <= rest), 1).otherwise(0)
    return rows.withColumn("copies", (F.col("epochs") + extra).cast("long")).select(
        "doc_id", "size", "source_size", "source", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "mark"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was taken, with the columns of docs.

    Rows that agree in id, source and text share their plan: where it gives some of them one copy more, which is so for
    those at a source's boundary alone, they are numbered, and the first ones get it.
    """
    names = docs.columns
    rows = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(names)])
    own = {c: F.col(f"c{names.index(c)}") for c in ("doc_id", "source", "text")}
    rows = rows.select("*", own["doc_id"].alias("d_id"), own["source"].cast("string").alias("d_source"), mark(own["text"]).alias("d_mark"))
    plan = _plan(docs, **options).groupBy("doc_id", "source", "mark").agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.sum("copies").alias("copies"), F.count("*").alias("times"))
    plan = common.written(plan.filter("most > 0"), "mix-plan")
    joined = lambda plan: rows.join(plan, F.col("d_id").eqNullSafe(F.col("doc_id")) & F.col("d_source").eqNullSafe(F.col("source")) & (F.col("d_mark") == F.col("mark")))
    even = joined(plan.filter("least = most")).withColumn("turns", F.col("least"))
    odd = joined(common.small_side(plan.filter("least < most")))
    number = F.row_number().over(W.partitionBy("d_id", "d_source", "d_mark").orderBy(*[f"c{k}" for k, c in enumerate(names) if c in own]))
    odd = odd.withColumn("turns", F.col("least") + (number <= F.col("copies") - F.col("least") * F.col("times")).cast("long"))
    both = even.select(*rows.columns, "turns").union(odd.select(*rows.columns, "turns")).filter("turns > 0")
    return both.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("turns").cast("int")))).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT doc_id, source,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS symbols
  FROM d
), k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370497.0)
           / ((size + 1)::DOUBLE / (size + 1 + 4 * symbols)::DOUBLE) AS key
  FROM s
), z AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), p AS (
  SELECT source, source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight
  FROM z
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM p
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM c
), f AS (
  SELECT (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source ASC NULLS LAST LIMIT 1) AS final
), t AS (
  SELECT source, source_size, CASE WHEN final IS NULL OR final >= ratio THEN cap ELSE final * weight END AS target FROM l, f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.size, k.source, e.source_size, e.target, e.epochs,
         (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
), x AS (
  SELECT *, epochs + CASE WHEN target - epochs * source_size > 0 AND upto - size + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END AS copies FROM r
)
SELECT doc_id, size, source_size, source, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM x
"""
