"""Registered queries of builds that stop early, live progress, streams with state and ledgers; each reads whole tables or what their limits call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import similarity_ratio
from ..operators import progressive, splits, transitions
from ..sources import index, recordings, shapes
from ..streaming import ledger, progress, running
from . import tables
from .registry import registered
from .tables import STEPS_SQL, table

SHARDS, LIMITS = 16, {"train": 60, "validation": 4, "test": 4}


@registered(f"""
WITH {STEPS_SQL}, q AS (SELECT *, gameid % {SHARDS} AS shard, (gameid % {SHARDS}) * 1000000000000 + ordinal AS place FROM t),
k AS (SELECT split, task, place, row_number() OVER (PARTITION BY split, task ORDER BY place) AS n FROM q WHERE reason IS NULL),
l AS (SELECT split, task, place AS last FROM k WHERE n = CASE split WHEN 'train' THEN {LIMITS["train"]} ELSE {LIMITS["test"]} END),
z AS (SELECT CASE WHEN count(*) = 6 THEN max(last) END AS stop FROM l),
o AS (SELECT CASE WHEN stop IS NULL OR stop // 1000000000000 >= 15 THEN 16 ELSE list_min(list_filter([1, 3, 7, 15], lambda x: x > stop // 1000000000000)) END AS opened FROM z)
SELECT split, task, count(*) AS n, min(place) AS first_place, max(place) AS last_place, any_value(opened)::BIGINT AS shards_opened FROM q LEFT JOIN l USING (split, task), z, o
WHERE reason IS NULL AND (last IS NULL OR place <= last) AND (stop IS NULL OR place <= stop) GROUP BY 1, 2
""")
def early_stopping_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in shards, built until each split has its rows of both tasks: the limits are the feature, and later shards stay unread."""
    folder = ledger.shared_folder(spark, "shards")
    rows = table(spark, sf_dir, "conversations").withColumn("shard_index", F.pmod("conv_id", F.lit(SHARDS)).cast("int"))
    rows.repartition("shard_index").write.partitionBy("shard_index").parquet(folder)
    scan = spark.read.schema("conv_id long, turn long, role string, text string, shard_index int").parquet(folder)
    path = ledger.shared_folder(spark, "build")
    told = progressive.progressive_build(scan, path, shards=range(SHARDS), prepare=tables.steps_of, limits=LIMITS)
    kept = progressive.built(spark, path, "shard_index int, ordinal long, step int, split string, task string")
    place = F.col("shard_index").cast("long") * 1_000_000_000_000 + F.col("ordinal")
    opened = F.lit(progressive.totals(told)["shards"]).cast("long")
    return kept.groupBy("split", "task").agg(F.count("*").alias("n"), F.min(place).alias("first_place"), F.max(place).alias("last_place"), F.first(opened).alias("shards_opened"))


@registered()
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of whole turns that follow each other (tested against difflib)."""
    rows = transitions.pair_next(table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), "text", lane=["conv_id"], order=["turn"])
    return rows.filter("next_value IS NOT NULL").select("conv_id", "turn", F.round(similarity_ratio("text", "next_value"), 6).alias("similarity"))


@registered("""
WITH r AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM conversations)
SELECT conv_id AS gameid, step::INTEGER AS step, step * 0.25::DOUBLE AS seconds, sha256(replace(text, chr(13), '')) AS frame FROM r WHERE conv_id % 3 = 1 AND step < 3
""")
def decoded_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations recorded, then the first three frames of every third decoded: the prefix is the feature."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("gameid"), F.col("turn").alias("step"), F.replace("text", F.lit("\r"), F.lit("")).alias("frame"))
    folder = ledger.shared_folder(spark, "recordings")
    written = recordings.write_recordings(rows, folder)
    ledger.drained(written)
    frames = recordings.decoded_games(rows.filter("gameid % 3 = 1"), folder, frames=3)
    return frames.select("gameid", "step", "seconds", F.sha2(F.col("frame").cast("binary"), 256).alias("frame"))


@registered("""
SELECT o_orderpriority AS role, count(*) AS n_recordings, count(DISTINCT l_orderkey) AS n_games, sum(l_linenumber)::BIGINT AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1
""")
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as games and recordings in index files, read again as one table: the subset of some customers as players."""
    orders, folder = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("gameid"), F.col("o_orderpriority").alias("role"), "o_custkey"), ledger.shared_folder(spark, "index")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("gameid"), F.col("l_linenumber").cast("long").alias("part"))
    taken = splits.dealt(lines, "gameid").join(splits.dealt(orders.select("gameid", "o_custkey"), "gameid"), "gameid").select(F.concat_ws("/", F.col("o_custkey").cast("string"), "gameid").alias("path"), "part", "gameid")
    roots = table(spark, sf_dir, "region").agg(F.min("r_name").alias("dataset_name")).select("dataset_name", F.lit("/").alias("root"), F.lit(3).cast("long").alias("ttyrec_version"))
    ledger.drained(index.write_index(roots, orders.select("gameid", "role"), taken, folder, shards=8))
    chosen = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("player"))
    _, games, own = index.index_subset(spark, folder, chosen)
    return own.join(games, "gameid").groupBy("role").agg(F.count("*").alias("n_recordings"), F.countDistinct("gameid").alias("n_games"), F.sum("part").alias("parts"))


@registered("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events)
SELECT a.user_id, a.event_id, coalesce(string_agg(b.event_id::VARCHAR, ',' ORDER BY b.n), '') AS items FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 16 AND a.n - 1 GROUP BY ALL
""")
def streaming_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream with the last 16 of their user before them, kept as state; run until all there is was read."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    steps = source.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"))
    made = running.running_history(steps, game="user_id", step="event_id", time="at", items=["event_id"])
    return ledger.appended(made.select("user_id", "event_id", F.array_join(F.transform("history", lambda x: x["event_id"].cast("string")), ",").alias("items")))


@registered("SELECT count(*) AS processed, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors FROM events")
def live_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last record says that a build over the events, run as a stream, tells while it runs."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    live = progress.LiveProgress({"clicks": F.col("event_type") == "click", "errors": F.col("event_type") == "error"}, 1000, lambda record: None)
    folder = ledger.shared_folder(spark, "build")
    last = progress.watched(source, live, lambda df: df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    return spark.range(1).select(*[F.lit(last[c]).cast("long").alias(c) for c in ("processed", "clicks", "errors")])


@registered("SELECT event_type AS status, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def ledger_written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a ledger with numbered batches and commits, then counted by status."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    folder = ledger.shared_folder(spark, "ledger")
    once = progress.OnceLedger(spark, folder, "event_id long, status string")
    progress.run_ledger(source.select(F.col("event_id").cast("long").alias("event_id"), F.col("event_type").alias("status")), once, f"{folder}-state")
    return once.read().groupBy("status").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


SHAPES_SQL = """
WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 1 THEN left(props, 3) WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{"k": "x"}' WHEN 4 THEN '{}' WHEN 5 THEN '{"k": {"n": 3}}' ELSE props END AS text FROM events),
j AS (SELECT event_id, json_valid(text) AS valid, CASE WHEN json_valid(text) THEN text::JSON END AS v FROM t),
k AS (SELECT *, json_type(v) AS whole, json_type(v, '$.k') AS k, json_type(v, '$.k.n') AS n FROM j),
p AS (
  SELECT '$' AS path, CASE WHEN NOT valid THEN 'malformed' ELSE 'not_an_object' END AS problem, CASE WHEN valid THEN lower(whole) END AS found FROM k WHERE NOT valid OR whole <> 'OBJECT'
  UNION ALL SELECT '$.k', CASE WHEN k IS NULL THEN 'missing' ELSE 'wrong_kind' END, CASE k WHEN 'VARCHAR' THEN 'string' ELSE lower(k) END FROM k WHERE valid AND whole = 'OBJECT' AND (k IS NULL OR k NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))
  UNION ALL SELECT '$.k.n', 'missing', NULL FROM k WHERE valid AND whole = 'OBJECT' AND n IS NULL
)
SELECT path, problem, found, count(*) AS n FROM p GROUP BY ALL
"""


@registered(SHAPES_SQL)
def report_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' props as reports, some torn or of another shape: what is malformed, missing or of another kind."""
    case = F.col("event_id") % 7
    text = F.when(case == 1, F.substring("props", 1, 3)).when(case == 2, "[1, 2]").when(case == 3, '{"k": "x"}').when(case == 4, "{}").when(case == 5, '{"k": {"n": 3}}').otherwise(F.col("props"))
    rows = shapes.parsed(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    return shapes.problems(rows, {"$.k": "number", "$.k.n": "number"}, key="event_id").groupBy("path", "problem", "found").agg(F.count("*").alias("n"))
