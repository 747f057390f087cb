"""Helpers that the operators share: tables, folders, words and labelled samples."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these; ``bytes.split()`` cuts at just the same six bytes.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, as one document may hold 100,000 characters and more. This stays set for the session: a lazy result reads it when it runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what setCheckpointDir() was given; an own one in local mode alone."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        jvm_dir = context._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            root = jvm_dir.get()
        elif re.fullmatch(r"local(\[.*\])?", context.master):
            root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read back: cuts the lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark then removes a query's shuffle files as the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_clean(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, and the shuffle files of the write go as soon as it has ended."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sampled_labels(labels: DataFrame, label: str, bound: int, *, hold_out: bool) -> DataFrame:
    """At most ``bound`` labelled ids with 0/1 labels, chosen by a hash of the id (ids labelled twice: the larger label)."""
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if hold_out:
        rows = rows.filter(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def fits(df: DataFrame, rows: int = 300_000, size: int = 2**24) -> bool:
    """Whether df has few rows and bytes, as counted. df must be cheap to count (written)."""
    if df.limit(rows + 1).count() > rows:
        return False

    def held(name: str, kind: str) -> Column:
        if kind.startswith("array"):
            return F.greatest(F.size(name), F.lit(0)) * 8
        return F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.lit(8)

    held_bytes = sum((held(name, kind) for name, kind in df.dtypes), F.lit(8))
    return (df.agg(F.sum(held_bytes.cast("long"))).first()[0] or 0) <= size


def small_side(df: DataFrame, rows: int = 300_000, size: int = 2**24) -> DataFrame:
    """df, to be broadcast if it fits, else left to a shuffled join."""
    return F.broadcast(df) if fits(df, rows, size) else df


#: A key is hot if it has more than this many rows and more than a thousandth of all, so that there are fewer than 1,000 hot keys, whatever the input.
HOT_ROWS, HOT_SHARE = 10_000, 1000


def hot_keys(rows: DataFrame, key: str) -> dict[int, int]:
    """The hot keys of rows and how many parts, of at most the hot size on average, each is to be dealt into. rows must be cheap to count (written)."""
    size = max(HOT_ROWS, rows.count() // HOT_SHARE)
    return {r[key]: -(-r["n"] // size) for r in rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > size).collect()}


def salted_join(rows: DataFrame, side: DataFrame, key: str, spread: str, hot: dict[int, int]) -> DataFrame:
    """rows joined with side (one row a key) on key. Rows of hot keys are dealt by a hash of ``spread``; their rows of side are copied to each part."""
    if not hot:
        return rows.join(side, key)
    parts = F.broadcast(rows.sparkSession.createDataFrame(list(hot.items()), "_hot long, _parts long"))
    with_parts = lambda df: df.join(parts, df[key] == parts["_hot"], "left").drop("_hot").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long")))
    dealt = with_parts(rows).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_parts"))).drop("_parts")
    copied = with_parts(side).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 200, size: int = 2**20) -> Iterator[pa.RecordBatch]:
    """Parts of batches with at most so many rows and bytes of text in that column; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = min(first + rows, max(first + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(first, last - first)
            first = last


def release() -> None:
    """Give what a task has freed back to the system, as Python workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)
