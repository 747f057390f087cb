"""Readers: lazy DataFrames with declared schemas; filters and columns reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from . import schemas


def read_rows(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Supervised rows of JSON-lines files; blank lines are no rows."""
    return spark.read.schema(schemas.SUPERVISED_ROW).json(list(paths) if not isinstance(paths, str) else paths)


def read_rows_for_audit(spark: SparkSession, path: str) -> DataFrame:
    """Rows and the text of malformed ones in _corrupt_record, so that an audit can count them."""
    return spark.read.schema(f"{schemas.SUPERVISED_ROW}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard_index, shard_tar, shard_db of a manifest: a JSON array, one object, an object with ``shards``, or JSON lines.

    Relative paths are taken from the manifest's folder. An empty file gives no rows; a row without either path is an error.
    """
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    one = "struct<shard_tar: string, shard_db: string>"
    shards = (
        F.when(F.col("t").startswith("["), F.from_json("t", f"array<{one}>"))
        .when(F.get_json_object("t", "$.shards").isNotNull(), F.from_json("t", f"struct<shards: array<{one}>>")["shards"])
        .otherwise(F.transform(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, one)))
    )
    rows = text.filter("t != ''").select(F.posexplode(shards).alias("shard_index", "s"))
    folder = path.rsplit("/", 1)[0]
    checked = rows.select("shard_index", *[F.when(F.col(f"s.{c}").isNull(), F.raise_error(F.lit(f"archive manifest row lacks {c}"))).otherwise(resolved(F.col(f"s.{c}"), folder)).alias(c) for c in ("shard_tar", "shard_db")])
    return checked


def resolved(path: Column, folder: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(folder), path))


def archive_plan(games: Sequence[DataFrame]) -> DataFrame:
    """One row per gameid over the tables of all shards, the later shard's row where several have it."""
    tagged = [g.withColumn("shard_index", F.lit(k)) for k, g in enumerate(games)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    value = F.struct(*[F.col(c) for c in rows.columns if c != "gameid"])
    return rows.groupBy("gameid").agg(F.max_by(value, "shard_index").alias("v")).select("gameid", "v.*")


def shard_scan(batches: DataFrame, gameids: DataFrame | None = None, shard_indices: Sequence[int] | None = None) -> DataFrame:
    """Rows of some shards (partition pruning) and of some games (semi-join)."""
    if shard_indices is not None:
        batches = batches.filter(F.col("shard_index").isin(*shard_indices))
    return batches if gameids is None else batches.join(gameids.select("gameid").distinct(), "gameid", "left_semi")


def action_manifest(spark: SparkSession, path: str) -> DataFrame:
    """env_id, ordinal, action_id, nle_action_name, raw_key_code, key_label of a JSON manifest."""
    entry = "struct<action_id: int, nle_action_name: string, raw_key_code: int, key_label: string>"
    raw = spark.read.schema(f"env_id string, entries array<{entry}>").json(path, multiLine=True)
    return raw.select("env_id", F.posexplode("entries").alias("ordinal", "e")).select("env_id", "ordinal", "e.*")


def benchmark_registry(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(f"schema_version string, captured_at string, benchmarks array<{schemas.BENCHMARK}>, competitive_definition struct<required_external_benchmark_ids: array<string>>").json(path, multiLine=True)
    return raw.select("schema_version", "captured_at", F.col("competitive_definition.required_external_benchmark_ids").alias("declared"), F.explode("benchmarks").alias("b")).select("schema_version", "captured_at", "declared", "b.*")


def newest_reports(spark: SparkSession, glob: str, schema: str, limit: int) -> DataFrame:
    """The newest JSON reports under a glob, with their path and time, newest first; malformed ones are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).json(glob)
    tagged = rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    return tagged.filter("_corrupt_record IS NULL").drop("_corrupt_record").orderBy(F.desc("modified"), F.desc("path")).limit(limit)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def index_report(roots: DataFrame, games: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row: the first root by dataset name, and how many games and recordings there are."""
    first = roots.agg(F.min_by(F.struct("dataset_name", "root", "ttyrec_version"), "dataset_name").alias("r")).select(F.when(F.col("r").isNull(), F.raise_error(F.lit("the index has no root"))).otherwise(F.col("r")).alias("r")).select("r.*")
    return first.crossJoin(games.agg(F.count("*").alias("game_count"))).crossJoin(recordings.agg(F.count("*").alias("ttyrec_count")))


def player(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(path)


def players(recordings: DataFrame) -> DataFrame:
    return recordings.select(player(F.col("path")).alias("player")).distinct()


def player_subset(recordings: DataFrame, games: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordings of the chosen players, and the games of those recordings.

    The recordings are dealt out by game once they are chosen: few of them meet their games then, in as many parts as the shuffle has.
    """
    own = splits.dealt(recordings.withColumn("player", player(F.col("path"))).join(chosen.select("player").distinct(), "player", "left_semi"), "gameid")
    return own, games.join(own.select("gameid").distinct(), "gameid", "left_semi")


def label_readiness(version: Column, decoded_keys: Column) -> Column:
    """struct<status, reason>: whether decoded batches can give action labels. decoded_keys is NULL where none was sampled."""
    labelled = F.coalesce(F.arrays_overlap(decoded_keys, F.array(F.lit("keypresses"), F.lit("actions"))), F.lit(False))
    pair = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return (
        F.when(decoded_keys.isNotNull() & ~labelled, pair("frame_only", "decoded_action_labels_missing"))
        .when(labelled, pair("labelled", "decoded_action_labels_available"))
        .when(version >= 3, pair("probably_labelled", "ttyrec_version_supports_action_labels_but_decode_not_sampled"))
        .otherwise(pair("frame_only", "ttyrec_version_lacks_action_labels"))
    )


def first_frames(rows: DataFrame, limit: int) -> DataFrame:
    """The true next frames of the first next_frame rows by ordinal."""
    own = rows.filter("task = 'next_frame'")
    return own.orderBy("ordinal").limit(limit).select("ordinal", F.element_at("messages", 3)["content"].alias("frame"))


def eval_rows(spark: SparkSession, path: str, *, split: str, tasks: Sequence[str], mode: str, env_id: str, actions: Sequence[tuple[int, str]]) -> DataFrame:
    """Rows of one split of a written dataset, once its manifest, its actions and its rows agree with what is asked for.

    A wrong environment, mode or action list, a split unknown or without rows of a task, and rows outside the split table are errors.
    """
    if split not in ("train", "validation", "test"):
        raise ValueError(f"unknown split: {split}")
    manifest = spark.read.json(f"{path}/manifest").select("env_id", "mode").head()
    if manifest is None or (manifest["env_id"], manifest["mode"]) != (env_id, mode):
        raise ValueError(f"the dataset is of {manifest}, not of {env_id} and {mode}")
    own = [(r["action_id"], r["nle_action_name"]) for r in spark.read.schema(schemas.ACTIONS).json(f"{path}/action_manifest").orderBy("ordinal").collect()]
    if own != list(actions):
        raise ValueError("the dataset has other actions")
    rows = spark.read.schema(schemas.SUPERVISED_ROW).json(f"{path}/rows").filter((F.col("split") == split) & F.col("task").isin(*tasks))
    found = {r["task"]: r["n"] for r in rows.groupBy("task").agg(F.count("*").alias("n")).collect()}
    if missing := [t for t in tasks if not found.get(t)]:
        raise ValueError(f"no rows of {missing} in {split}")
    games = spark.read.schema(schemas.SPLIT_MANIFEST).json(f"{path}/split_manifest").filter(F.col("split") == split).select("gameid").distinct()
    if rows.join(games, "gameid", "left_anti").limit(1).count():
        raise ValueError("rows are missing from the split table")
    return rows


def dataset_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row on a written dataset: name, mode, accepted rows as its manifest says and as there are, and rejected rows.

    A dataset without manifest or rejection report was not completed, and reading it is an error.
    """
    manifest = spark.read.schema("dataset_name string, mode string, env_id string, accepted_rows bigint").json(f"{path}/manifest")
    rows = spark.read.schema(schemas.SUPERVISED_ROW).json(f"{path}/rows").agg(F.count("*").alias("row_count"), F.countDistinct("gameid").alias("game_count"))
    rejected = spark.read.schema(schemas.REJECTIONS).json(f"{path}/rejection_report").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rejected_rows"))
    return manifest.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(rejected))


def dataset_source(index: Column, root: Column, manifest: Column) -> Column:
    """archive_manifest or nld_db, from the paths that a run was given; none, or a manifest beside another path, fails the job."""
    return (
        F.when(manifest.isNotNull() & (index.isNotNull() | root.isNotNull()), F.raise_error(F.lit("a manifest can't be combined with an index or a root")))
        .when(manifest.isNotNull(), "archive_manifest")
        .when(index.isNull(), F.raise_error(F.lit("a run needs an index or a manifest")))
        .otherwise("nld_db")
    )


def games_of(plan: DataFrame, shard_index: int) -> DataFrame:
    return plan.filter(F.col("shard_index") == shard_index).select("gameid")


def initial_frames(rows: DataFrame, count: int) -> DataFrame:
    """ordinal, frame: the current observations of the first rows, policy rows and next-frame rows alike."""
    first = rows.orderBy("ordinal").limit(count)
    user = F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)["content"]
    return first.select("ordinal", F.substring_index(user, "Current observation:\n", -1).alias("frame"))


def valid_actions(manifest: DataFrame) -> DataFrame:
    """One row: the action ids of a manifest in its order."""
    return manifest.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "action_id"))), lambda x: x["action_id"]).alias("valid_action_ids"))


def file_entries(spark: SparkSession, path: str) -> DataFrame:
    """path, name and size of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size_bytes"))
