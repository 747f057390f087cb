"""Queries of reports read back, failures of runs, versions and contexts of unknown shape, and merged tables of shards, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, reports, splits
from ..sources import readers, shapes
from ..streaming import ledger
from . import tables
from .registry import registered, split_sql
from .tables import SEED, WATCH_SQL, table


@registered(f"""
WITH {WATCH_SQL}, d AS (SELECT *, seed || '-' || side AS run_id FROM f WHERE death IS NOT NULL)
SELECT run_id, 'failed' AS status, CASE WHEN arg_min(prompted, step) THEN 'prompt' ELSE 'step' END AS failure_stage, 'EpisodeEnd' AS error_type, arg_min(death, step) AS error_message,
       '/contracts/' || run_id || '.json' AS contract_path, CASE WHEN run_id LIKE '%current' THEN 'online' ELSE 'offline' END AS mode, CASE WHEN arg_min(step, step) % 2 = 0 THEN '{{"step": ' || min(step) || '}}' END AS tracker
FROM d GROUP BY run_id
""")
def failed_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each rollout that ended in a death, of its first one; odd steps have an empty report of the tracker."""
    from ..functions import events

    rows = tables.watch_events(spark, sf_dir).withColumn("run_id", F.concat_ws("-", "seed", "side"))
    attempts = rows.select(
        "run_id",
        F.col("step").alias("ordinal"),
        F.when(events.is_prompt(), "prompt").otherwise("step").alias("stage"),
        F.when(F.col("death").isNotNull(), "EpisodeEnd").alias("error_type"),
        F.col("death").alias("error_message"),
        F.concat(F.lit("/contracts/"), "run_id", F.lit(".json")).alias("contract_path"),
        F.when(F.col("side") == "current", "online").otherwise("offline").alias("mode"),
        F.when(F.col("step") % 2 == 0, F.format_string('{"step": %d}', "step")).otherwise("").alias("tracker"),
    )
    return reports.failure_reports(attempts)


@registered("""
SELECT CASE event_id % 6 WHEN 0 THEN 'v' || user_id % 5 WHEN 1 THEN 'w' || user_id % 5 WHEN 2 THEN 'w' || user_id % 5 ELSE 'v0' END AS version, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1
""")
def objective_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rollout reports whose version is on one side, of another kind, empty, missing or in torn text."""
    case = F.col("event_id") % 6
    side = lambda s, v: F.concat(F.lit(f'"{s}": {{"fitness_objective_version": '), v, F.lit("}"))
    text = lambda c: F.concat(F.lit(f'"{c}'), (F.col("user_id") % 5).cast("string"), F.lit('"'))
    sides = (
        F.when(case == 0, F.concat_ws(", ", side("current", text("v")), side("baseline", text("w"))))
        .when(case == 1, F.concat_ws(", ", side("current", F.lit('""')), side("baseline", text("w"))))
        .when(case == 2, F.concat_ws(", ", side("current", F.lit("7")), side("baseline", text("w"))))
        .when(case == 3, side("baseline", F.lit("null")))
        .otherwise("")
    )
    whole = F.when(case == 4, '{"rollout_metrics": [1]}').when(case == 5, '{"rollout_metrics": {').otherwise(F.concat(F.lit('{"rollout_metrics": {'), sides, F.lit("}}")))
    rows = shapes.parsed(table(spark, sf_dir, "events").select("event_id", whole.alias("text")), "text")
    told = rows.select("event_id", shapes.objective_version(F.col("report"), "v0").alias("version"))
    return told.groupBy("version").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@registered("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[{"observation_text":"' || event_type || '","action_id":' || user_id || '},{"action_id":1,"observation_text":"seen"}]'
       WHEN 1 THEN '[{"observation_text":"' || user_id || '","action_id":2}]' WHEN 2 THEN '[]' END AS context FROM events
""")
def policy_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of events as pairs and as objects, empty ones, and ones that are no arrays."""
    case = F.col("event_id") % 4
    mixed = F.format_string('[["%s", %d], {"observation_text": "seen", "action_id": 1}]', "event_type", "user_id")
    text = F.when(case == 0, mixed).when(case == 1, F.format_string("[[%d, 2]]", "user_id")).when(case == 2, "[]").otherwise('{"a": 1}')
    rows = shapes.parsed(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    return rows.select("event_id", shapes.context_text(F.col("report")).alias("context"))


@registered("SELECT CASE WHEN p_size % 3 = 0 THEN 'archive_manifest' ELSE 'nld_db' END AS source, count(*) AS n FROM part GROUP BY 1")
def dataset_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as runs that were given a manifest, an index, or an index and a root."""
    case, name = F.col("p_size") % 3, F.col("p_name")
    source = readers.dataset_source(F.when(case > 0, name), F.when(case == 2, name), F.when(case == 0, name))
    return table(spark, sf_dir, "part").groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@registered("SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def reports_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each type of event, written as a file of its own beside a torn one, and read as the newest reports; the torn one is left out."""
    folder = ledger.shared_folder(spark, "reports")
    told = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    # one row for each kind: rows of a folder are one file's
    told.withColumn("folder", F.xxhash64("kind")).repartition("folder").write.partitionBy("folder").json(f"{folder}/whole")
    told.limit(1).select(F.substring(F.to_json(F.struct("*")), 1, 5)).coalesce(1).write.text(f"{folder}/whole/folder=0")
    return readers.newest_reports(spark, f"{folder}/whole/*", "kind string, n bigint, users bigint", 100).select("kind", "n", "users")


@registered(f"""
WITH s AS (SELECT DISTINCT {split_sql(SEED, 'o_custkey')} AS split, o_custkey FROM orders)
SELECT split, count(*) AS games, sum(o_custkey)::BIGINT AS ids FROM s GROUP BY 1
""")
def merged_split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split tables of five shards, which share games, merged."""
    rows = splits.with_split(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gameid"), "o_orderpriority"), "gameid", SEED)
    shards = [rows.filter(F.col("o_orderpriority").startswith(str(k))).select("split", "gameid").distinct() for k in range(1, 6)]
    return build.merge_splits(shards).groupBy("split").agg(F.count("*").alias("games"), F.sum("gameid").alias("ids"))


@registered("""
WITH m AS (SELECT DISTINCT c_nationkey, c_mktsegment, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'same' END AS identity FROM customer)
SELECT c_nationkey, count(DISTINCT identity) <= 1 AS mergeable FROM m GROUP BY 1
""")
def mergeable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as datasets and market segments as their shards: those of odd nations agree in what they are."""
    own = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise("same")
    manifests = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", own.alias("dataset_name"), F.lit("m").alias("mode"), F.array(F.lit("policy_action")).alias("tasks"), F.lit("true").alias("label_source"), F.lit(None).cast("string").alias("env_id"))
    return build.mergeable(manifests.distinct(), ["c_nationkey"])
