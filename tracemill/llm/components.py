"""Connected components by distributed label propagation; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id reachable from each id that has a link.

    Large-star and small-star steps alternate until the links no longer change: each hangs neighbours on a smaller
    one, so that in the end all of a component hang on its smallest id. Rows a step makes never outnumber those it
    reads by more than the vertices, and map-side minima keep a hub's links from meeting in one task before they shrink.
    """
    edges = common.checkpointed(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = large.filter("u != v").distinct()
        low = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = common.checkpointed(small.filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
