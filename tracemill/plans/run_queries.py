"""Queries of ledgers, sources, registries, parsing and reports over runs, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import frames, scalars
from ..operators import compare, history, planes, reports, rollouts, transitions
from ..sources import readers, writers
from ..streaming import ledger
from . import queries as base
from . import tables
from .registry import registered
from .tables import SEED, table

# Ledgers


@registered(f"WITH {base.STATES_SQL} SELECT DISTINCT name FROM u WHERE status LIKE 'uploaded%'")
def completed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.completed(base.uploads(spark, sf_dir))


@registered(f"WITH {base.STATES_SQL} SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT name FROM u WHERE status LIKE 'uploaded%') AND c_custkey IN (SELECT o_custkey FROM orders) ORDER BY 1 LIMIT 25")
def pending_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 25 customers with orders that have no upload yet: the limit is the feature."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"))
    only = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name")).distinct()
    return ledger.plan_uploads(names, ledger.completed(base.uploads(spark, sf_dir)), only, limit=25)


@registered("SELECT count(*) AS event_count, max((props::JSON ->> '$.k')::BIGINT) AS max_k, max(user_id) AS max_user_id, 0::BIGINT AS max_event_type FROM events")
def ledger_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.get_json_object("props", "$.k").alias("k"), "user_id", "event_type")
    return ledger.progress_summary(rows, ["k", "user_id", "event_type"]).drop("latest")


@registered("SELECT floor(epoch(date_trunc('hour', ts)))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.windowed_counts(table(spark, sf_dir, "events"), time="ts", group="event_type")
    return found.select(tables.epoch_seconds(F.col("window.start")).alias("start"), "event_type", "n")


@registered("""
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts) + INTERVAL 30 MINUTE))::BIGINT AS "end", count(*) AS n FROM n GROUP BY user_id, session
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.session_counts(table(spark, sf_dir, "events"), time="ts", group="user_id")
    return found.select("user_id", tables.epoch_seconds(F.col("session_window.start")).alias("start"), tables.epoch_seconds(F.col("session_window.end")).alias("end"), "n")


@registered("SELECT DISTINCT p_brand AS name, '/source/' || p_brand AS source_path, 'shard-' || (p_size % 5) AS shard_path, 'uploaded_shard' AS status, 0 AS returncode, 0.0::DOUBLE AS elapsed_seconds FROM part")
def shard_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of brands as players, in shards by size."""
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), "p_size")
    return reports.shard_records(names, source_root="/source", shard_path=F.concat(F.lit("shard-"), (F.col("p_size") % 5).cast("string")))


@registered("""
WITH b AS (SELECT event_id // 100 AS k, count(*) AS n, max(event_id) AS last, count(*) FILTER (event_type = 'click') AS policy_rows, count(*) FILTER (event_type = 'view') AS frame_rows FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS event_id, event_type FROM events) GROUP BY 1)
SELECT (sum(n) OVER w)::BIGINT AS processed, last::BIGINT AS last, (sum(policy_rows) OVER w)::BIGINT AS policy_rows, (sum(frame_rows) OVER w)::BIGINT AS frame_rows FROM b WINDOW w AS (ORDER BY k)
""")
def build_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build over the events reports after every hundredth."""
    rows = transitions.dense_numbers(table(spark, sf_dir, "events").select("event_id", "event_type"), key="event_id", order=["event_id"], alias="ordinal")
    kind = F.col("event_type")
    return ledger.progress_records(rows.withColumn("ordinal", F.col("ordinal").cast("long")), 100, {"policy_rows": kind == "click", "frame_rows": kind == "view"})


@registered("""
WITH e AS (SELECT event_id % 100 AS r, event_type FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (CASE event_type WHEN 'click' THEN r > 0 AND (r % 32 = 0 OR r >= 90) WHEN 'view' THEN r > 0 AND r % 32 = 0 WHEN 'error' THEN r > 0 AND (r % 32 = 0 OR r >= 50) ELSE false END) AS saved FROM e GROUP BY 1
""")
def saved_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as progress of rows (of 90), windows (of unknown many) and cases (of 50)."""
    done = (F.col("event_id") % 100).cast("int")
    of = lambda kind: F.when(F.col("event_type") == kind, done)
    most = lambda kind, n: F.when(F.col("event_type") == kind, n)
    none = F.lit(None).cast("int")
    record = F.struct(
        of("click").alias("evaluated_rows"), most("click", 90).alias("max_rows"), of("view").alias("evaluated_windows"), none.alias("max_windows"), none.alias("evaluated_frames"), none.alias("max_frames"), of("error").alias("evaluated_cases"),
        most("error", 50).alias("max_cases"),
    )
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(ledger.worth_saving(record)).alias("saved"))


# Sources


@registered("""
WITH s AS (SELECT o_orderkey AS gameid, o_custkey AS value, o_orderkey % 3 AS shard_index FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1000000, 3 FROM orders WHERE o_orderkey % 5 = 0)
SELECT gameid, arg_max(value, shard_index) AS value, max(shard_index)::INTEGER AS shard_index FROM s GROUP BY 1
""")
def archive_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games of four shards; the last one has some of them again."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gameid"), F.col("o_custkey").alias("value"))
    shards = [orders.filter(F.col("gameid") % 3 == k) for k in range(3)]
    return readers.archive_plan([*shards, orders.filter("gameid % 5 = 0").withColumn("value", F.col("value") + 1000000)])


@registered("SELECT l_orderkey % 4 AS shard_index, count(*) AS n FROM lineitem WHERE l_orderkey % 4 IN (1, 3) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1")
def shard_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards of the lines, of urgent orders alone."""
    batches = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).alias("shard_index"), F.col("l_orderkey").alias("gameid"))
    games = table(spark, sf_dir, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("gameid"))
    return readers.shard_scan(batches, games, [1, 3]).groupBy("shard_index").agg(F.count("*").alias("n"))


@registered("""
SELECT CASE WHEN p_size % 4 = 1 THEN 'frame_only' WHEN p_size % 4 = 2 THEN 'labelled' WHEN p_size % 4 = 3 THEN 'labelled' WHEN p_size % 5 >= 3 THEN 'probably_labelled' ELSE 'frame_only' END AS status,
  CASE WHEN p_size % 4 = 1 THEN 'decoded_action_labels_missing' WHEN p_size % 4 IN (2, 3) THEN 'decoded_action_labels_available' WHEN p_size % 5 >= 3 THEN 'ttyrec_version_supports_action_labels_but_decode_not_sampled' ELSE 'ttyrec_version_lacks_action_labels' END AS reason, count(*) AS n FROM part GROUP BY ALL
""")
def label_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recordings of several versions, decoded with and without actions."""
    k = F.col("p_size") % 4
    decoded = F.when(k == 1, F.array(F.lit("tty_chars"))).when(k == 2, F.array(F.lit("tty_chars"), F.lit("keypresses"))).when(k == 3, F.array(F.lit("actions")))
    rows = table(spark, sf_dir, "part").select(readers.label_readiness(F.col("p_size") % 5, decoded).alias("r"))
    return rows.groupBy("r.status", "r.reason").agg(F.count("*").alias("n"))


@registered("SELECT event_type AS nle_action_name, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS ordinal, (row_number() OVER (ORDER BY event_type) + 9)::INTEGER AS action_id, 'events-v0' AS env_id FROM (SELECT DISTINCT event_type FROM events)")
def action_manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as an action list, written as one JSON document and read again."""
    kinds = table(spark, sf_dir, "events").groupBy("event_type").count().agg(F.sort_array(F.collect_list("event_type")).alias("k"))
    path = ledger.shared_folder(spark, "action-manifest")
    actions = kinds.select(F.posexplode("k").alias("ordinal", "nle_action_name")).select("*", (F.col("ordinal") + 10).alias("action_id"), (F.col("ordinal") + 97).alias("raw_key_code"), F.char(F.col("ordinal") + 97).alias("key_label"))
    writers.write_action_manifest(actions, path, "events-v0")
    return readers.action_manifest(spark, path).select("env_id", "ordinal", "action_id", "nle_action_name")


@registered("SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INTEGER AS shard_index, '/archive/shard-' || s_suppkey || '.tar' AS shard_tar, '/archive/' || s_suppkey || '.db' AS shard_db FROM supplier")
def archive_manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as shards of an archive manifest, absolute and relative paths, written as one JSON document and read again."""
    folder = ledger.shared_folder(spark, "archive")
    rows = table(spark, sf_dir, "supplier").agg(F.sort_array(F.collect_list(F.struct("s_suppkey"))).alias("s"))
    path = lambda x, tail, head: F.concat(F.lit(head), x["s_suppkey"].cast("string"), F.lit(tail))
    shards = F.transform("s", lambda x: F.struct(path(x, ".tar", "/archive/shard-").alias("shard_tar"), path(x, ".db", "").alias("shard_db")))
    rows.select(F.to_json(F.struct(shards.alias("shards")))).coalesce(1).write.text(f"{folder}/manifest")
    found = readers.archive_manifest(spark, f"{folder}/manifest")
    return found.select("shard_index", "shard_tar", F.replace("shard_db", F.lit(folder), F.lit("/archive")).alias("shard_db"))


# Registries and comparisons


@registered("""
WITH b AS (SELECT CASE WHEN item_id % 17 = 0 THEN '' WHEN item_id % 5 = 0 THEN 'twice' ELSE 'b' || item_id END AS benchmark_id, item_id % 7 <> 0 AS has_protocol, item_id % 11 <> 0 AS has_source, item_id % 4 = 1 AS required, item_id % 3 = 0 AS reference, item_id % 13 <> 0 AS has_metric FROM benchmark),
r AS (SELECT *, count(*) OVER (PARTITION BY benchmark_id) > 1 AS repeated FROM b),
f AS (SELECT benchmark_id, unnest(list_filter([CASE WHEN repeated OR benchmark_id = '' THEN 'duplicate_or_empty_id' END, CASE WHEN NOT has_protocol OR NOT has_source THEN 'protocol_or_source_missing' END, CASE WHEN required AND reference THEN 'required_reference_only' END, CASE WHEN required AND NOT has_metric THEN 'required_without_metric' END], lambda x: x IS NOT NULL)) AS failure FROM r)
SELECT benchmark_id, failure, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT NULL, 'declared_required_set_differs', 1
""")
def registry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as registry entries with defects by id; the declared set names an entry that there isn't."""
    i = F.col("item_id")
    unless = lambda n, text: F.when(i % n != 0, text).otherwise("")
    registry = table(spark, sf_dir, "benchmark").select(
        F.when(i % 17 == 0, "").when(i % 5 == 0, "twice").otherwise(F.concat(F.lit("b"), i.cast("string"))).alias("benchmark_id"), unless(7, "p").alias("protocol_id"), unless(11, "s").alias("source"), (i % 4 == 1).alias("required_for_competitive"),
        F.when(i % 3 == 0, "reference_only").otherwise("candidate_lower_at_least_target_lower").alias("comparison"), unless(13, "m").alias("candidate_metric"), F.array(F.lit("nowhere")).alias("declared"),
    )
    return compare.registry_failures(registry).groupBy("benchmark_id", "failure").agg(F.count("*").alias("n"))


@registered("""
WITH m AS (SELECT user_id % 6 AS run, 'next_' || CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 5 ELSE 10 END || '_frame_sequence_' || CASE WHEN event_id % 2 = 0 THEN 'window' ELSE 'frame' END || '_count' AS metric, sum(CASE WHEN user_id % 6 = 0 THEN 0 ELSE 1 END)::DOUBLE AS value
           FROM events WHERE NOT (user_id % 6 = 1 AND event_type = 'view') GROUP BY 1, 2),
w AS (SELECT DISTINCT m.run, 'next_' || h.h || '_frame_sequence_' || s.s || '_count' AS metric FROM m, (VALUES (1), (5), (10)) h(h), (VALUES ('window'), ('frame')) s(s))
SELECT run, metric, CASE WHEN value IS NULL THEN 'missing' ELSE 'empty' END AS failure FROM w LEFT JOIN m USING (run, metric) WHERE value IS NULL OR value <= 0
""")
def evidence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and frames per horizon that runs lack: run 0 has none that count, run 1 none of horizon 5."""
    run = F.col("user_id") % 6
    horizon = F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "view", "5").otherwise("10")
    metric = F.concat(F.lit("next_"), horizon, F.lit("_frame_sequence_"), F.when(F.col("event_id") % 2 == 0, "window").otherwise("frame"), F.lit("_count"))
    rows = table(spark, sf_dir, "events").filter(~((run == 1) & (F.col("event_type") == "view")))
    return compare.sequence_evidence(rows.groupBy(run.alias("run"), metric.alias("metric")).agg(F.sum((run != 0).cast("int")).cast("double").alias("value")))


@registered("SELECT count(DISTINCT o_orderstatus) = 1 AS o_orderstatus, count(DISTINCT o_orderpriority) = 1 AS o_orderpriority, true AS kind FROM orders")
def report_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.one_identity(table(spark, sf_dir, "orders").withColumn("kind", F.lit("order")), ["o_orderstatus", "o_orderpriority", "kind"])


@registered("""
WITH r AS (SELECT count(*)::DOUBLE AS n, (max(user_id) > 0)::INTEGER::DOUBLE AS positive, count(DISTINCT user_id)::DOUBLE AS users, count(*) FILTER (event_type = 'click')::DOUBLE AS clicks FROM events)
SELECT 'rows' AS path, n AS value FROM r UNION ALL SELECT 'any', positive FROM r UNION ALL SELECT 'inner/users', users FROM r UNION ALL SELECT 'inner/kinds/clicks', clicks FROM r
""")
def flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report as paths and numbers; texts and missing numbers are left out."""
    clicks = F.count_if(F.col("event_type") == "click")
    one = table(spark, sf_dir, "events").agg(F.count("*").alias("rows"), (F.max("user_id") > 0).alias("any"), F.countDistinct("user_id").alias("users"), clicks.alias("clicks"))
    nested = F.struct(F.col("users"), F.struct("clicks", F.lit(None).cast("double").alias("none")).alias("kinds"), F.lit("text").alias("name"))
    return compare.flat_numbers(one.select("rows", "any", nested.alias("inner")))


WANTED = [("fitness", "fitness_score", "improved", None), ("walls", "wall_message_count", "at_most", 3.0), ("progress", "live_progress_event_count", "above", 0.5), ("still", "non_advancing_step_count", "not_regressed", None), ("other", "absent_metric", "above", 0.0)]


@registered(f"""
{base.SUMMARY_SQL}, m AS (SELECT side, avg(round(fitness_score, 6)) AS fitness_score, avg(wall_message_count) AS wall_message_count, avg(clean_count) AS live_progress_event_count, avg(non_advancing_step_count) AS non_advancing_step_count FROM u GROUP BY 1),
c AS (SELECT round(c.fitness_score - b.fitness_score, 6) > 0 AS fitness, c.wall_message_count <= 3 AS walls, c.live_progress_event_count > 0.5 AS progress, round(c.non_advancing_step_count - b.non_advancing_step_count, 12) >= 0 AS still FROM m c, m b WHERE c.side = 'current' AND b.side = 'baseline')
SELECT 'fitness' AS name, CASE WHEN fitness THEN 'passed' ELSE 'failed' END AS status FROM c UNION ALL SELECT 'walls', CASE WHEN walls THEN 'passed' ELSE 'failed' END FROM c UNION ALL SELECT 'progress', CASE WHEN progress THEN 'passed' ELSE 'failed' END FROM c
UNION ALL SELECT 'still', CASE WHEN still THEN 'passed' ELSE 'failed' END FROM c UNION ALL SELECT 'other', 'missing'
""".replace("c AS (SELECT round", "cc AS (SELECT round").replace("FROM c UNION", "FROM cc UNION").replace("FROM c\n", "FROM cc\n"))
def watch_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements on the means of rollouts: improvement, ceilings, floors, and a metric that there isn't."""
    names = ["fitness_score", "wall_message_count", "live_progress_event_count", "non_advancing_step_count"]
    told = rollouts.summaries(tables.watch_events(spark, sf_dir)).withColumn("fitness_score", F.round("fitness_score", 6))
    means = told.groupBy("side").agg(*[F.avg(n).alias(n) for n in names])
    long = means.select("side", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("side", "m.*")
    wanted = spark.createDataFrame(WANTED, "name string, metric string, mode string, bound double")
    return compare.requirements(wanted, compare.compared(long.filter("side = 'baseline'"), long.filter("side = 'current'"))).select("name", "status")


@registered(f"""
WITH r AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang ORDER BY {base.bucket_sql(SEED, 'doc_id')}, doc_id) AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents),
p AS (SELECT a.doc_id, arg_min(b.doc_id, (b.n - a.n + a.c) % a.c) AS other FROM r a JOIN r b ON a.lang = b.lang AND a.source <> b.source GROUP BY 1),
g AS (SELECT d.lang, d.source AS target, CASE WHEN d.n_chars % 2 = 0 THEN d.source ELSE 'web' END AS plain, CASE WHEN p.other IS NOT NULL THEN CASE WHEN o.n_chars % 2 = 0 THEN o.source ELSE 'web' END END AS shuffled FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN documents o ON o.doc_id = p.other)
SELECT count(*) AS input_row_count, count(shuffled) AS case_count, count(DISTINCT lang) AS comparable_group_count, count(DISTINCT lang) FILTER (shuffled IS NOT NULL) AS used_group_count,
       round(count(*) FILTER (shuffled IS NOT NULL AND plain = target)::DOUBLE / count(shuffled), 6) AS natural_exact_match_rate, round(count(*) FILTER (shuffled = target)::DOUBLE / count(shuffled), 6) AS shuffled_exact_match_rate,
       round(count(*) FILTER (plain <> shuffled)::DOUBLE / count(shuffled), 6) AS prediction_change_rate, count(DISTINCT lang) - count(DISTINCT lang) FILTER (shuffled IS NOT NULL) AS skipped_group_count,
       round(round(count(*) FILTER (shuffled IS NOT NULL AND plain = target)::DOUBLE / count(shuffled), 6) - round(count(*) FILTER (shuffled = target)::DOUBLE / count(shuffled), 6), 6) AS dependence_gap FROM g
""")
def state_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from documents and from the partners of shuffled pairs: a predictor that names the source of every other text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(F.col("n_chars") % 2 == 0, F.col("source")).otherwise("web").alias("natural"))
    pairs = compare.shuffled_pairs(docs.select("doc_id", "lang", "source"), group=["lang"], key="doc_id", label="source", seed=SEED).select("doc_id", "other_key")
    other = docs.select(F.col("doc_id").alias("other_key"), F.col("natural").alias("shuffled"))
    cases = docs.join(pairs, "doc_id", "left").join(other, "other_key", "left").withColumnRenamed("source", "target")
    return compare.sensitivity(cases, ["lang"])


# Reports over runs


@registered("""
WITH m AS (SELECT o_custkey % 40 AS run, o_orderpriority AS name, left(o_orderpriority, 1) <> '5' AS required, count(*) % 5 <> 0 AS present FROM orders GROUP BY 1, 2)
SELECT run, count(*) AS marker_count, coalesce(string_agg(name, ',' ORDER BY name) FILTER (required AND NOT present), '') AS missing_markers, count(*) FILTER (required AND NOT present) = 0 AS ready FROM m GROUP BY 1
""")
def run_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as markers of runs; those of the lowest priority aren't required."""
    markers = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("run"), F.col("o_orderpriority").alias("name")).agg((F.count("*") % 5 != 0).alias("present"))
    return reports.readiness(markers.withColumn("required", ~F.col("name").startswith("5"))).withColumn("missing_markers", F.array_join("missing_markers", ","))


@registered("""
SELECT CASE WHEN item_id % 5 = 0 THEN CASE WHEN item_id % 2 = 0 THEN 'improvement_proved' WHEN item_id % 3 = 0 THEN 'rejected_live_control' ELSE 'proof_failed' END
            WHEN item_id % 7 < 4 THEN CASE WHEN item_id % 11 = 0 THEN 'build_incomplete' WHEN item_id % 3 > 0 THEN 'build_running' ELSE 'build_stalled' END
            WHEN item_id % 4 = 0 THEN 'evaluation_incomplete' ELSE 'proof_missing' END AS state, count(*) AS n FROM benchmark GROUP BY 1
""")
def goal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as goals in all states."""
    i = F.col("item_id")
    passed = F.when(i % 5 == 0, i % 2 == 0)
    failed = F.when(i % 3 == 0, F.array(F.lit("exact"), F.lit("watch_action_repeat_rate"))).otherwise(F.array(F.lit("exact")))
    activity = reports.build_activity(i % 11 != 0, F.concat(F.lit(" "), (i % 3).cast("string")))
    state = reports.goal_state(passed, failed, i % 7 >= 4, activity, i % 4 != 0)
    return table(spark, sf_dir, "benchmark").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@registered("""
WITH r AS (SELECT user_id % 30 AS lane, CASE WHEN user_id % 4 = 0 THEN 'corrected-' ELSE 'run-' END || user_id AS run, round(avg(value), 6) AS score FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY run LIKE 'corrected-%' DESC, coalesce(score, 0) DESC, run) AS n FROM r)
SELECT lane, run, score FROM k WHERE n = 1
""")
def best_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best report of each lane, corrected runs before others."""
    run = F.concat(F.when(F.col("user_id") % 4 == 0, "corrected-").otherwise("run-"), F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 30).alias("lane"), run.alias("run")).agg(F.round(scalars.mean(F.col("value")), 6).alias("score"))
    return reports.best_report(rows, run="run", value="score", prefix="corrected-", key=["lane"])


@registered(f"""
{base.SUMMARY_SQL} SELECT c.seed, round(c.fitness_score, 6) AS current_fitness, round(b.fitness_score, 6) AS baseline_fitness, c.cumulative_reward - b.cumulative_reward AS reward_delta, (c.zero_progress - b.zero_progress)::DOUBLE AS zero_progress_delta
FROM u c FULL JOIN (SELECT * FROM u WHERE side = 'baseline') b ON c.seed = b.seed WHERE c.side = 'current'
""")
def sweep_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of every seed with a current side, and their differences."""
    told = reports.dashboard(rollouts.summaries(tables.watch_events(spark, sf_dir)), ["seed"]).filter("current IS NOT NULL")
    return told.select(
        "seed", F.round("current.fitness_score", 6).alias("current_fitness"), F.round("baseline.fitness_score", 6).alias("baseline_fitness"), F.col("deltas.cumulative_reward").alias("reward_delta"), F.col("deltas.zero_progress_episode").alias("zero_progress_delta")
    )


@registered(f"""
WITH {tables.WATCH_SQL} SELECT seed, side, step::INTEGER AS step, md5('- action_id=' || coalesce(action_id::VARCHAR, 'None') || ' reward=' || reward::VARCHAR || ' total=' || cumulative_reward::VARCHAR || ' hp=' || hp || ' depth=' || depth || ' advanced=' || (NOT still)::VARCHAR) AS feedback_md5 FROM f
""")
def result_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback of every rollout step from its own result, up to the message."""
    line = F.regexp_replace(history.feedback_text(F.array(history.result_feedback())), "^Recent action feedback:\n| message=.*$", "")
    return tables.watch_events(spark, sf_dir).select("seed", "side", "step", F.md5(line.cast("binary")).alias("feedback_md5"))


@registered("SELECT user_id, floor(epoch(max(ts)))::BIGINT AS last FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id DESC LIMIT 12")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve reports: the limit is the feature."""
    return reports.newest(table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last")), 12, time="last", name="user_id").withColumn("last", tables.epoch_seconds(F.col("last")))


@registered("SELECT count(*) AS report_count, (sum(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey END))::BIGINT AS game_total, (sum(s_nationkey))::BIGINT AS ttyrec_total FROM supplier")
def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as shard reports, some without a readable count."""
    rows = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "none").otherwise(F.col("s_suppkey").cast("string")).alias("selected_game_count"), F.col("s_nationkey").alias("selected_ttyrec_count"))
    return reports.shard_summary(rows)


@registered("""
WITH t AS (SELECT DISTINCT event_type FROM events), m AS (SELECT event_type AS name, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS action_id FROM t),
e AS (SELECT CASE WHEN action_id = 2 THEN 'other' ELSE name END AS name, CASE WHEN action_id = 4 THEN 9 ELSE action_id END AS action_id FROM m)
SELECT action_id, m.name AS manifest_name, e.name AS environment_name, CASE WHEN e.name IS NULL THEN 'missing_in_environment' WHEN m.name IS NULL THEN 'missing_in_manifest' ELSE 'name_differs' END AS failure FROM m FULL JOIN e USING (action_id) WHERE m.name IS DISTINCT FROM e.name
""")
def action_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action list of event types against an environment with another name and another id."""
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    manifest = kinds.withColumn("action_id", F.row_number().over(W.orderBy("name")) - 1)
    environment = manifest.select(F.when(F.col("action_id") == 2, "other").otherwise(F.col("name")).alias("name"), F.when(F.col("action_id") == 4, 9).otherwise(F.col("action_id")).alias("action_id"))
    return reports.space_failures(manifest, environment)


@registered("""
SELECT 'split' || (l_orderkey % 3) AS split, CASE WHEN l_linenumber % 4 = 0 THEN 'bad_key' ELSE 'accepted' END AS reason, count(*) AS n, count(DISTINCT l_orderkey % 4) AS workers FROM lineitem GROUP BY 1, 2
""")
def worker_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of four workers, merged."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).alias("worker"), F.concat(F.lit("split"), (F.col("l_orderkey") % 3).cast("string")).alias("split"), F.when(F.col("l_linenumber") % 4 == 0, "bad_key").alias("reason"))
    return planes.merged_counts(rows.groupBy("worker", "split", "reason").agg(F.count("*").alias("n")))


@registered(f"""
WITH {tables.WATCH_SQL} SELECT seed, side, count(*) AS n, count(action_id) AS acted, sum(reward) AS reward, min(step)::INTEGER AS first_step, max(step)::INTEGER AS last_step FROM f GROUP BY ALL
""")
def unnested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts nested as reports with both sides of each step, taken apart again."""
    side = F.struct("action_id", "reward", "message")
    steps = tables.watch_events(spark, sf_dir).groupBy("run_id", "seed", "step").agg(*[F.max(F.when(F.col("side") == s, side)).alias(s) for s in ("current", "baseline")])
    nested = steps.groupBy("run_id", "seed").agg(F.collect_list(F.struct("step", "current", "baseline")).alias("events"))
    return rollouts.long_events(nested).groupBy("seed", "side").agg(
        F.count("*").alias("n"), F.count("action_id").alias("acted"), F.sum("reward").alias("reward"), F.min("step").alias("first_step"), F.max("step").alias("last_step")
    )


@registered(f"""
WITH {tables.WATCH_SQL} SELECT seed, count(*) AS n_steps, count(c.step) AS current_steps, count(b.step) AS baseline_steps, count(*) FILTER (c.action_id = b.action_id) AS same_actions
FROM (SELECT * FROM f WHERE side = 'current') c FULL JOIN (SELECT * FROM f WHERE side = 'baseline') b USING (seed, step) GROUP BY 1
""")
def paired_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts of both sides, step by step."""
    rows = tables.watch_events(spark, sf_dir)
    sides = [rows.filter(F.col("side") == s).select("run_id", "seed", "step", "action_id", "reward") for s in ("current", "baseline")]
    return rollouts.paired_sides(*sides).groupBy("seed").agg(F.count("*").alias("n_steps"), F.count("current").alias("current_steps"), F.count("baseline").alias("baseline_steps"), F.count_if("same_action").alias("same_actions"))


@registered("SELECT role, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars, (SELECT sum(1 + 1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))::BIGINT FROM conversations) AS lines FROM conversations GROUP BY 1")
def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one session of play, written as events and frames, and both read again."""
    path = ledger.shared_folder(spark, "session")
    steps = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("step"), "role", F.coalesce("text", F.lit("")).alias("frame"))
    writers.write_session(steps, path)
    lines = spark.read.text(f"{path}/frames").agg(F.count("*").alias("lines"))
    events = spark.read.schema("step long, role string, frame string").json(f"{path}/events")
    return events.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("frame")).cast("long").alias("chars")).crossJoin(F.broadcast(lines))


# Parsing


@registered(f"""
{base.BUILT_SQL} SELECT 'context_2' AS mode, ((length(user_text) - length(replace(user_text, 'Previous action_id:', ''))) // 19)::BIGINT AS context_length, 'unknown' AS role,
  CASE WHEN step <= 1 THEN '1' WHEN step <= 3 THEN '2-3' WHEN step <= 6 THEN '4-6' ELSE '7+' END AS depth, count(*) AS n FROM b GROUP BY ALL
""")
def matching_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of rows whose frames may be swapped."""
    length = compare.context_length(F.lit(None), frames.last_content(F.col("messages"), "user"))
    key = compare.matching_key(F.col("mode"), length, F.lit(""), F.col("step"))
    return base.built_rows(spark, sf_dir).groupBy(key.alias("k")).agg(F.count("*").alias("n")).select("k.*", "n")


@registered("""
SELECT role, count(*) AS n, sum(CASE WHEN turn % 3 = 0 THEN turn % 5 + 1 ELSE 11 END)::BIGINT AS horizon_sum, count(*) FILTER (turn % 4 > 0) AS named, md5(string_agg(DISTINCT CASE WHEN turn % 4 = 0 THEN 'Kind' ELSE 'Kind.' || upper(role) END, ',' ORDER BY CASE WHEN turn % 4 = 0 THEN 'Kind' ELSE 'Kind.' || upper(role) END)) AS names_md5,
       count(*) FILTER (coalesce(nullif(text, ''), role) = role) AS fallbacks FROM conversations GROUP BY 1
""")
def parsed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizons, names of actions and tasks, and first values that there are."""
    t = F.col("turn")
    horizons = scalars.horizon_list(F.when(t % 3 == 0, (t % 5 + 1).cast("string")).otherwise(" 1, 10,"))
    name = scalars.action_name(F.lit("Kind"), F.when(t % 4 > 0, F.upper("role")))
    tasks = scalars.name_list(F.lit("next_frame, policy_action,next_frame"), ["policy_action", "next_frame"])
    rows = table(spark, sf_dir, "conversations").select("role", horizons.alias("h"), name.alias("name"), scalars.first_present(F.col("text"), F.col("role")).alias("first"), tasks.alias("tasks"))
    rows = rows.filter(F.size("tasks") == 2)
    return rows.groupBy("role").agg(
        F.count("*").alias("n"), F.sum(F.aggregate("h", F.lit(0), lambda a, x: a + x)).alias("horizon_sum"), F.count_if(F.col("name") != "Kind").alias("named"),
        F.md5(F.array_join(F.sort_array(F.collect_set("name")), ",").cast("binary")).alias("names_md5"), F.count_if(F.col("first") == F.col("role")).alias("fallbacks"),
    )


@registered("""
WITH e AS (SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k FROM events)
SELECT CASE WHEN k % 10 = 9 THEN 'unknown' WHEN k // 10 <= 1 THEN '1' WHEN k // 10 <= 3 THEN '2-3' WHEN k // 10 <= 6 THEN '4-6' ELSE '7+' END AS depth, CASE WHEN k + 30 BETWEEN 32 AND 126 THEN chr(k + 30) ELSE 'keycode_' || (k + 30) END AS label,
       count(*) AS n, sum(k + CASE WHEN k % 2 = 0 THEN 7 ELSE 0 END)::BIGINT AS listed, count(*) FILTER (k % 2 = 1) AS unreadable FROM e GROUP BY 1, 2
""")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths, key labels and lists of integers, some of them unreadable."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.concat(F.lit(" "), F.col("k").cast("string"), F.lit(", ,"), F.when(F.col("k") % 2 == 0, "7").otherwise("x"))
    rows = table(spark, sf_dir, "events").withColumn("k", k).withColumns({"list": scalars.int_list(text), "d": F.when(F.col("k") % 10 == 9, "deep").otherwise(F.floor(F.col("k") / 10).cast("string"))})
    total = F.aggregate("list", F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return rows.groupBy(scalars.depth_bucket(F.col("d")).alias("depth"), scalars.key_label(F.col("k") + 30).alias("label")).agg(
        F.count("*").alias("n"), F.sum(total).alias("listed"), F.count_if(F.exists("list", lambda x: x.isNull())).alias("unreadable")
    )


@registered(f"""
{base.BUILT_SQL} SELECT task, count(*) AS n, sum(length(user_text) - length(replace(user_text, 'Previous action_id:', 'Previous action_id')))::BIGINT AS context_items, sum(length(regexp_replace(o.text, chr(10) || '+$', '')))::BIGINT AS first_chars, sum(length(o.text))::BIGINT AS last_chars,
  sum(CASE WHEN length(user_text) > 200 THEN 212 ELSE length(user_text) END)::BIGINT AS sampled_chars FROM b JOIN (SELECT conv_id AS gameid, turn AS step, coalesce(text, '<missing>') AS text FROM conversations) o USING (gameid, step) GROUP BY 1
""")
def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts taken apart at their markers: items of context, the current observation, and samples of 200 characters."""
    user = frames.last_content(F.col("messages"), "user")
    rows = base.built_rows(spark, sf_dir).select("task", user.alias("u"))
    size = lambda c: F.sum(F.length(c)).cast("long")
    return rows.groupBy("task").agg(
        F.count("*").alias("n"), F.sum(compare.context_length(F.lit(None), F.col("u"))).alias("context_items"), size(frames.after_first_marker(F.col("u"))).alias("first_chars"), size(frames.after_last_marker(F.col("u"))).alias("last_chars"),
        size(frames.sample_text(F.col("u"), 200)).alias("sampled_chars"),
    )


@registered("""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, role FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' THEN 'Recent action feedback:' || chr(10) || '- action_id=' || turn || ' reward=<unknown> total=<unknown> hp=None depth=None advanced=<unknown> message="<missing>"' || chr(10) || chr(10) || 'Current rendered observation:' || chr(10) || text ELSE text END) AS prompt_md5 FROM c
""")
def prompts_with_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations under the feedback of the turn, which assistant turns have."""
    unknown, none = F.lit("<unknown>"), F.lit(None).cast("int")
    item = F.struct(F.col("turn").alias("action_id"), unknown.alias("reward"), unknown.alias("cumulative_reward"), none.alias("hp"), none.alias("depth"), unknown.alias("game_time_advanced"), F.lit("").alias("message"))
    feedback = F.when(F.col("role") == "assistant", F.array(item)).otherwise(F.slice(F.array(item), 1, 0))
    shown = history.with_feedback(F.coalesce("text", F.lit("")), feedback)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(shown.cast("binary")).alias("prompt_md5"))


@registered("""
WITH v AS (SELECT vec_id, unnest(range(64)) AS k, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x FROM embeddings), m AS (SELECT *, x > 0 AS masked, row_number() OVER (PARTITION BY vec_id, x > 0 ORDER BY abs(x) DESC, k) AS n, count(*) OVER (PARTITION BY vec_id, x > 0) AS c FROM v),
r AS (SELECT *, masked AND n <= c - 10 AS revealed FROM m)
SELECT vec_id, count(*) FILTER (masked AND NOT revealed) AS still_masked, coalesce(sum(k) FILTER (revealed), 0)::BIGINT AS revealed_places FROM r GROUP BY 1
""")
def revealed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive components as masked cells, of which the largest are revealed until ten are left."""
    cells = F.transform("embedding", lambda x, k: F.struct(F.lit(-1).alias("value"), (x > 0).alias("masked"), k.alias("prediction"), F.abs(x.cast("double")).alias("confidence")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", planes.revealed(cells, F.lit(10)).alias("r"))
    places = F.aggregate("r", F.lit(0), lambda a, c: a + F.greatest(c["value"], F.lit(0)))
    return rows.select("vec_id", F.size(F.filter("r", lambda c: c["masked"])).cast("long").alias("still_masked"), places.cast("long").alias("revealed_places"))
