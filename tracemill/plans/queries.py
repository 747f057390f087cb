"""Registered queries of the trace engine and their SQL twins: each applies one operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import frames, scalars
from ..functions.similarity import similarity_ratio
from ..operators import audit, build, compare, history, labels, metrics, rollouts, splits, transitions
from ..sources import readers
from ..streaming import ledger
from . import tables
from .registry import ORACLES, QUERIES, bucket_sql, registered, split_sql  # noqa: F401
from .tables import EVENTS_SQL, METRICS_SQL, SEED, STEPS_SQL, WATCH_SQL, table

# Index and splits


@registered("SELECT min(r_name) AS dataset_name, (SELECT count(*) FROM orders) AS game_count, (SELECT count(*) FROM lineitem) AS ttyrec_count FROM region")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").select(F.col("r_name").alias("dataset_name"), F.lit("/").alias("root"), F.lit(3).alias("ttyrec_version"))
    return readers.index_report(roots, table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")).select("dataset_name", "game_count", "ttyrec_count")


@registered("SELECT DISTINCT split_part(p_name, ' ', 1) AS player FROM part")
def distinct_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.players(table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("/")).alias("path")))


@registered("""
SELECT o_orderpriority, count(*) AS n_recordings, count(DISTINCT l_orderkey) AS n_games FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1
""")
def player_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    chosen = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("player"))
    lines, players = splits.dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey"), splits.dealt(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    recordings = lines.join(players, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("/", F.col("o_custkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"), F.col("l_orderkey").alias("gameid"))
    own, games = readers.player_subset(recordings, orders.withColumnRenamed("o_orderkey", "gameid"), chosen)
    return own.join(games.select("gameid", "o_orderpriority"), "gameid").groupBy("o_orderpriority").agg(F.count("*").alias("n_recordings"), F.countDistinct("gameid").alias("n_games"))


@registered(f"SELECT {split_sql(SEED, 'doc_id')} AS split, source, count(*) AS n FROM documents GROUP BY 1, 2")
def hash_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.with_split(table(spark, sf_dir, "documents"), "doc_id", SEED).groupBy("split", "source").agg(F.count("*").alias("n"))


@registered(f"""
WITH s AS (SELECT doc_id, {split_sql(SEED, 'doc_id')} AS split FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('7:' || split || ':' || doc_id), doc_id) AS n FROM s)
SELECT doc_id, split FROM r WHERE n <= CASE split WHEN 'train' THEN 50 ELSE 10 END
""")
def hash_topn_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort of 50 / 10 / 10 keys: the limits are the feature."""
    rows = splits.with_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED)
    return splits.top_by_hash(rows, "doc_id", SEED, {"train": 50, "validation": 10, "test": 10})


@registered(f"""
WITH s AS (SELECT doc_id AS gameid, coalesce(nullif(lang, ''), '<missing>') AS role, {split_sql(SEED, 'doc_id')} AS split FROM documents)
SELECT gameid, role, split, CASE split WHEN 'validation' THEN 0 WHEN 'test' THEN 1 ELSE 2 END AS split_rank,
       row_number() OVER (PARTITION BY split, role ORDER BY {bucket_sql(SEED + 1, 'gameid')}, gameid)::INTEGER - 1 AS turn FROM s
""")
def round_robin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gameid"), F.col("lang").alias("role"))
    return splits.split_role_order(games, SEED).select("gameid", "role", "split", "split_rank", "turn")


@registered(f"""
WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
s AS (SELECT d.doc_id, lang, source, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN l USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, quality ORDER BY {bucket_sql(SEED, 'doc_id')}, doc_id)::INTEGER - 1 AS turn FROM s)
SELECT doc_id, lang, source, quality, turn FROM r ORDER BY turn, lang, source, quality LIMIT 100
""")
def stratified_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit cohort of 100: the limit is the feature."""
    labelled = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labelled, "doc_id", "left").fillna(-1, ["quality"])
    return splits.stratified(rows, strata=["lang", "source", "quality"], key="doc_id", seed=SEED, limit=100)


@registered(f"""
WITH s AS (SELECT doc_id, {split_sql(SEED, 'doc_id')} AS split FROM documents), k AS (SELECT doc_id, count(DISTINCT split) AS c FROM s GROUP BY 1)
SELECT split, count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, (SELECT count(*) FROM k WHERE c > 1) AS shared_keys FROM s GROUP BY 1
""")
def disjoint_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.with_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED)
    shared = splits.overlaps(rows, "doc_id").agg(F.coalesce(F.sum("overlap_count"), F.lit(0)).alias("shared_keys"))
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_keys")).crossJoin(F.broadcast(shared))


# Transitions, history, islands


@registered("SELECT conv_id, turn, length(lead(text) OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS next_chars, md5(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS next_md5 FROM conversations")
def pair_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transitions.pair_next(table(spark, sf_dir, "conversations"), "text", lane=["conv_id"], order=["turn"])
    return rows.select("conv_id", "turn", F.length("next_value").alias("next_chars"), F.md5(F.col("next_value").cast("binary")).alias("next_md5"))


@registered("""
SELECT conv_id, turn, CASE WHEN role <> 'system' AND lead(conv_id) OVER w = conv_id THEN lead(turn) OVER w END AS next_turn
FROM conversations WINDOW w AS (PARTITION BY conv_id % 10 ORDER BY conv_id, turn)
""")
def pair_next_done_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lanes of several traces each: a pair must not cross traces, nor follow a row marked done (system)."""
    rows = table(spark, sf_dir, "conversations").withColumns({"lane": F.col("conv_id") % 10, "done": F.col("role") == "system"})
    return transitions.pair_next(rows, "turn", lane=["lane"], order=["conv_id", "turn"], game="conv_id", done="done", alias="next_turn").select("conv_id", "turn", "next_turn")


@registered("SELECT event_id, user_id || ':' || first_value(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_id FROM events")
def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("stamp", tables.epoch_seconds(F.col("ts")))
    return transitions.sequence_ids(rows, lane=["user_id"], order=["ts", "event_id"], game="user_id", stamp="stamp").select("event_id", "sequence_id")


@registered("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT a.conv_id, a.turn, count(b.n) AS n_items, coalesce(string_agg(b.turn || ':' || b.role, ',' ORDER BY b.n), '') AS items
FROM r a LEFT JOIN r b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 3 AND a.n - 1 GROUP BY 1, 2
""")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.with_history(table(spark, sf_dir, "conversations"), game="conv_id", order=["turn"], items=["turn", "role"])
    shown = history.for_mode(F.col("history"), "context_3", 0)
    return rows.select("conv_id", "turn", F.size(shown).cast("long").alias("n_items"), F.array_join(F.transform(shown, lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), ",").alias("items"))


@registered("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, coalesce(length(text), 0) + length(turn::VARCHAR) AS size FROM conversations),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM r)
SELECT a.conv_id, a.turn, count(b.n) AS n_items, coalesce(sum(b.size), 0)::BIGINT AS n_chars
FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 16 AND a.n - 1 AND a.upto - a.size - b.upto + b.size <= 4000 GROUP BY 1, 2
""")
def history_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("observation_text"), F.col("turn").alias("action_id"))
    rows = history.with_history(rows, game="conv_id", order=["turn"], items=["observation_text", "action_id"])
    shown = history.for_mode(F.col("history"), "growing_context", 1000)
    size = F.aggregate(shown, F.lit(0).cast("long"), lambda a, x: a + F.length(x["observation_text"]) + F.length(x["action_id"].cast("string")))
    return rows.select("conv_id", "turn", F.size(shown).cast("long").alias("n_items"), size.alias("n_chars"))


@registered("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
j AS (SELECT a.conv_id, a.turn, b.turn AS t, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.n DESC) AS back
      FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 8 AND a.n - 1 AND b.role = 'assistant')
SELECT r.conv_id, r.turn, count(t) AS n_items,
       CASE WHEN count(t) = 0 THEN '' ELSE 'Recent action feedback:' || chr(10) || string_agg('- action_id=' || t || ' reward=<unknown> total=<unknown> hp=None depth=None advanced=<unknown> message="turn ' || t || '"', chr(10) ORDER BY t) END AS feedback
FROM r LEFT JOIN j ON r.conv_id = j.conv_id AND r.turn = j.turn AND back <= 6 GROUP BY 1, 2
""")
def feedback_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback of assistant turns among the last eight turns, rendered as at most six lines."""
    unknown = F.lit("<unknown>")
    made = F.struct(
        F.col("turn").alias("action_id"), unknown.alias("reward"), unknown.alias("cumulative_reward"), F.lit(None).cast("int").alias("hp"), F.lit(None).cast("int").alias("depth"),
        unknown.alias("game_time_advanced"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("message"),
    )
    rows = table(spark, sf_dir, "conversations").withColumn("feedback", F.when(F.col("role") == "assistant", made))
    rows = history.with_history(rows, game="conv_id", order=["turn"], items=["feedback"])
    shown = F.transform(history.for_mode(F.col("history"), "feedback_context_8", 0), lambda x: x["feedback"])
    return rows.select("conv_id", "turn", F.size(history.last_items(shown, 6)).cast("long").alias("n_items"), history.feedback_text(shown).alias("feedback"))


@registered("""
WITH e AS (SELECT user_id, event_id, datediff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS day FROM events),
b AS (SELECT *, CASE WHEN day = lag(day) OVER w + 1 THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day, event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY day, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT user_id, island::BIGINT AS island, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM i GROUP BY 1, 2
""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", tables.day(F.col("ts")).alias("day"))
    return transitions.islands(rows, key=["user_id"], step="day", order=["event_id"]).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@registered("""
WITH b AS (SELECT conv_id, turn, CASE WHEN turn = lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1 THEN 0 ELSE 1 END AS s FROM conversations),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM b),
g AS (SELECT conv_id, island, count(*) AS n FROM i GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS row_count, count(DISTINCT conv_id) AS episode_count, count(*) AS segment_count, max(n) AS max_segment_length,
       sum(greatest(0, n - 0))::BIGINT AS next_1_windows, sum(greatest(0, n - 0))::BIGINT AS next_1_frames, count(*) FILTER (n >= 1) AS next_1_segments,
       sum(greatest(0, n - 4))::BIGINT AS next_5_windows, (5 * sum(greatest(0, n - 4)))::BIGINT AS next_5_frames, count(*) FILTER (n >= 5) AS next_5_segments,
       sum(greatest(0, n - 9))::BIGINT AS next_10_windows, (10 * sum(greatest(0, n - 9)))::BIGINT AS next_10_frames, count(*) FILTER (n >= 10) AS next_10_segments FROM g
""")
def sequence_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.window_availability(table(spark, sf_dir, "conversations"), key="conv_id", step="turn")


@registered("""
WITH r AS (SELECT conv_id, turn, role, lead(turn, 2) OVER w AS t2, lead(turn, 1) OVER w AS t1, lead(role, 1) OVER w AS r1, lead(role, 2) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn FROM r WHERE t1 = turn + 1 AND t2 = turn + 2 AND role <> 'system' AND r1 <> 'system' AND r2 <> 'system'
""")
def rollout_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.rollout_starts(table(spark, sf_dir, "conversations"), sequence="conv_id", step="turn", horizon=3, candidate=F.col("role") != "system").select("conv_id", "turn")


@registered("SELECT user_id, (row_number() OVER (ORDER BY ts, event_id) - 1)::INTEGER AS sequence_number FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dense_sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.dense_numbers(table(spark, sf_dir, "events"), key="user_id", order=["ts", "event_id"]).select("user_id", "sequence_number").distinct()


# Building rows


@registered("""
SELECT event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 1 END::BIGINT AS n_actions, CASE event_type WHEN 'click' THEN 0 WHEN 'signup' THEN 4 END AS action_id, count(*) AS n FROM events GROUP BY 1
""")
def keymap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with one action, with two and with none."""
    actions = spark.createDataFrame([("click", 0), ("view", 1), ("view", 2), ("signup", 4)], "raw_key_code string, action_id int")
    rows = table(spark, sf_dir, "events").withColumn("raw_key_code", F.col("event_type"))
    return build.with_action(rows, build.key_map(actions)).groupBy("event_type", "n_actions", "action_id").agg(F.count("*").alias("n"))


@registered(f"WITH {STEPS_SQL} SELECT split, task, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM t GROUP BY ALL")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build.accepted_by_task(tables.conversation_steps(spark, sf_dir))
    return rows.groupBy("split", "task", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@registered(f"""
WITH {STEPS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY split, task ORDER BY ordinal) > 40 AS over_quota FROM t WHERE reason IS NULL)
SELECT split, task, over_quota, count(*) AS n, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal FROM q GROUP BY ALL
""")
def split_task_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = build.accepted_by_task(tables.conversation_steps(spark, sf_dir)).filter("reason IS NULL")
    return build.capped(accepted, 40).groupBy("split", "task", "over_quota").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))


@registered(f"""
WITH {STEPS_SQL}, p AS (SELECT ordinal FROM t WHERE task = 'policy_action' AND reason IS NULL ORDER BY ordinal LIMIT 100), l AS (SELECT max(ordinal) AS last, count(*) AS n FROM p)
SELECT task, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM t, l WHERE l.n < 100 OR ordinal <= last GROUP BY ALL
""")
def global_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build that ends at its 100th policy row: the limit is the feature."""
    rows = build.global_cap(build.accepted_by_task(tables.conversation_steps(spark, sf_dir)), 100)
    return rows.groupBy("task", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def built_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tasks from conversations, with two items of history."""
    steps = tables.conversation_steps(spark, sf_dir).filter("action_id IS NOT NULL").withColumn("observation_text", F.coalesce("observation_text", F.lit("<missing>")))
    with_items = history.with_history(steps, game="gameid", order=["step"], items=["observation_text", "action_id"])
    shown = history.for_mode(F.col("history"), "context_2", 0)
    policy = build.policy_row(with_items, "talk", "context_2", [0, 1, 2], shown)
    frame = build.frame_row(with_items.filter("next_value IS NOT NULL").withColumn("next_text", F.col("next_value")), "talk", "context_2", shown)
    return policy.unionByName(frame)


BUILT_SQL = f"""
WITH {STEPS_SQL}, o AS (SELECT gameid, step, split, action_id, coalesce(text, '<missing>') AS text, next_text FROM s WHERE action_id IS NOT NULL),
h AS (SELECT *, lag(text, 1) OVER w AS t1, lag(action_id, 1) OVER w AS a1, lag(text, 2) OVER w AS t2, lag(action_id, 2) OVER w AS a2 FROM o WINDOW w AS (PARTITION BY gameid ORDER BY step)),
p AS (SELECT *, CASE WHEN t1 IS NULL THEN '' ELSE 'Recent history:' || chr(10) || CASE WHEN t2 IS NULL THEN '' ELSE t2 || chr(10) || 'Previous action_id: ' || a2 || chr(10) END
             || t1 || chr(10) || 'Previous action_id: ' || a1 || chr(10) END || 'Current observation:' || chr(10) || text AS tail FROM h),
b AS (
  SELECT gameid, step, split, 'policy_action' AS task, 'Allowed action_ids: [0, 1, 2]' || chr(10) || tail AS user_text, '{{"action_id": ' || action_id || '}}' AS assistant_text, action_id FROM p
  UNION ALL
  SELECT gameid, step, split, 'next_frame', 'Action taken: {{"action_id": ' || action_id || '}}' || chr(10) || tail, substr(next_text, 1, 4096), action_id FROM p WHERE next_text IS NOT NULL
)
"""


@registered(f"{BUILT_SQL} SELECT gameid, step, split, task, 'talk:' || gameid AS episode_id, md5(user_text) AS user_md5, md5(assistant_text) AS assistant_md5 FROM b")
def build_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda role: F.md5(frames.last_content(F.col("messages"), role).cast("binary")).alias(f"{role}_md5")
    return built_rows(spark, sf_dir).select("gameid", "step", "split", "task", "episode_id", digest("user"), digest("assistant"))


@registered(f"{BUILT_SQL} SELECT split, task, count(*) AS n FROM b GROUP BY 1, 2")
def merge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards by trace, counted apart in one pass and merged."""
    counts = built_rows(spark, sf_dir).groupBy((F.col("gameid") % 4).alias("shard"), "split", "task").agg(F.count("*").alias("n"))
    return build.merge_counts([counts.drop("shard")])


@registered(f"""
{BUILT_SQL}, r AS (SELECT *, (row_number() OVER (PARTITION BY task ORDER BY gameid, step) - 1)::INTEGER AS turn FROM b)
SELECT gameid, step, task, turn, CASE task WHEN 'policy_action' THEN 0 ELSE 1 END AS task_rank FROM r WHERE turn < 10
""")
def interleaved_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows per task in turn: the limit is the feature."""
    return build.interleaved(built_rows(spark, sf_dir), 10, order=["gameid", "step"]).select("gameid", "step", "task", "turn", "task_rank")


@registered(f"SELECT doc_id, source FROM documents WHERE {bucket_sql(SEED, 'doc_id')} < 0.25::DOUBLE")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents by hash: sampling is the feature."""
    return splits.bernoulli(table(spark, sf_dir, "documents"), "doc_id", SEED, 0.25).select("doc_id", "source")


# Audits


@registered("SELECT md5(text) AS text_md5, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_identities(table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5")), ["text_md5"])


@registered("""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
r AS (SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'label_missing' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' END AS reason FROM documents d LEFT JOIN l USING (doc_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS example FROM r WHERE reason IS NOT NULL)
SELECT reason, doc_id, example::INTEGER AS example FROM e WHERE example <= 5
""")
def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five examples per reason: the limit is the feature."""
    labelled = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    reason = F.when(F.col("quality").isNull(), "label_missing").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labelled, "doc_id", "left").select("doc_id", reason.alias("reason"))
    return labels.examples(rows, "reason", 5, order=["doc_id"]).select("reason", "doc_id", "example")


@registered("""
WITH l AS (SELECT CASE WHEN toxic = 1 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, max(quality) AS q FROM labels GROUP BY 1), d AS (SELECT doc_id, max((n_chars > 1000)::INTEGER) AS p FROM documents GROUP BY 1)
SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS paired, count(*) FILTER (l.doc_id IS NULL) AS policy_only, count(*) FILTER (d.doc_id IS NULL) AS frame_only,
       count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND p <> q) AS mismatched FROM d FULL JOIN l ON d.doc_id = l.doc_id
""")
def paired_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all labels as rows of the two tasks; labels of toxic documents have identities that no document has."""
    policy = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("label"), F.col("doc_id").alias("ordinal"))
    own = F.when(F.col("toxic") == 1, F.col("doc_id") + 1000000000).otherwise(F.col("doc_id"))
    frame = table(spark, sf_dir, "labels").groupBy(own.alias("doc_id")).agg(F.max("quality").alias("label")).withColumn("ordinal", F.col("doc_id"))
    return audit.paired(policy, frame, ["doc_id"])


@registered(f"""
WITH s AS (SELECT DISTINCT md5(text) AS h, {split_sql(SEED, 'doc_id')} AS split FROM documents)
SELECT a.split AS left_split, b.split AS right_split, count(*) AS overlap_count FROM s a JOIN s b ON a.h = b.h AND a.split < b.split GROUP BY 1, 2
""")
def cross_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.with_split(table(spark, sf_dir, "documents"), "doc_id", SEED).select(F.md5(F.col("text").cast("binary")).alias("h"), "split")
    return splits.overlaps(rows, "h")


@registered(f"""
WITH s AS (SELECT DISTINCT lang || '/' || source AS role, {split_sql(SEED, 'doc_id')} AS split FROM documents), w AS (SELECT unnest(['validation', 'test']) AS split)
SELECT w.split, t.role FROM (SELECT role FROM s WHERE split = 'train') t, w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.role = t.role AND s.split = w.split)
""")
def role_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.with_split(table(spark, sf_dir, "documents"), "doc_id", SEED).withColumn("role", F.concat_ws("/", "lang", "source"))
    return audit.coverage_gaps(rows, "role")


@registered("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, sum(n)::BIGINT AS total, count(*) AS unique_action_count, max(event_type) FILTER (k = 1) AS dominant_action, (max(n) FILTER (k = 1))::BIGINT AS dominant_count,
       round((max(n) FILTER (k = 1))::DOUBLE / sum(n), 6) AS dominant_rate, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS histogram FROM r GROUP BY 1
""")
def action_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.action_distribution(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@registered(f"""
{BUILT_SQL}, x AS (SELECT split, task, count(*) AS n FROM t WHERE reason IS NULL GROUP BY 1, 2), y AS (SELECT split, task, count(*) AS n FROM b GROUP BY 1, 2)
SELECT split, task, coalesce(x.n, 0) AS expected, coalesce(y.n, 0) AS actual, coalesce(x.n, 0) = coalesce(y.n, 0) AS agrees FROM x FULL JOIN y USING (split, task)
""")
def count_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = build.accepted_by_task(tables.conversation_steps(spark, sf_dir)).filter("reason IS NULL").groupBy("split", "task").agg(F.count("*").alias("n"))
    actual = built_rows(spark, sf_dir).groupBy("split", "task").agg(F.count("*").alias("n"))
    return audit.reconciliation(expected, actual, ["split", "task"])


# Metrics


def predicted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the user's previous type as the prediction."""
    return tables.event_steps(spark, sf_dir).withColumns({"prediction": F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")), "label": F.col("event_type")})


PREDICTED_SQL = "p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prediction, event_type AS label FROM events)"


@registered(f"""
WITH {PREDICTED_SQL}, t AS (SELECT label, count(*) AS n, count(*) FILTER (prediction = label) AS x FROM p GROUP BY 1), q AS (SELECT prediction, count(*) AS n FROM p WHERE prediction IS NOT NULL AND prediction <> 'error' GROUP BY 1),
td AS (SELECT label FROM t ORDER BY n DESC, label LIMIT 1), pd AS (SELECT prediction, n FROM q ORDER BY n DESC, prediction LIMIT 1)
SELECT count(*) AS row_count, count(*) FILTER (prediction = label) AS exact, round(count(prediction)::DOUBLE / count(*), 6) AS parse_valid_rate,
       round(count(*) FILTER (prediction IS NOT NULL AND prediction <> 'error')::DOUBLE / count(*), 6) AS action_space_valid_rate, round(count(*) FILTER (prediction = label)::DOUBLE / count(*), 6) AS exact_match_rate,
       round((SELECT avg(x::DOUBLE / n) FROM t), 6) AS macro_action_accuracy,
       round((SELECT sum(x)::DOUBLE / sum(n) FROM t WHERE label <> (SELECT label FROM td)), 6) AS non_modal_exact_match_rate,
       (SELECT count(*) FROM q) AS predicted_unique, (SELECT prediction FROM pd) AS predicted_dominant, round((SELECT n FROM pd)::DOUBLE / count(*), 6) AS predicted_dominant_rate,
       (SELECT count(*) FROM t) AS target_unique, (SELECT label FROM td) AS target_dominant, ((SELECT n FROM pd)::DOUBLE / count(*) > 0.5)::INTEGER AS dominant_action_collapse
FROM p
""")
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.policy_metrics(predicted_events(spark, sf_dir), F.coalesce(F.col("prediction") != "error", F.lit(False)))


@registered(f"WITH {PREDICTED_SQL} SELECT label, prediction, count(*) AS n FROM p WHERE prediction IS NOT NULL GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.confusion(predicted_events(spark, sf_dir), "label", "prediction")


@registered("""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
r AS (SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, coalesce(nullif(source, ''), 'unknown') AS source, quality IS NOT NULL AND toxic = 0 AS mapped, n_chars >= 200 AS has_pseudo,
             quality = (n_chars > 1000)::INTEGER AS same, quality = 1 AS north FROM documents LEFT JOIN l USING (doc_id)),
g AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension, CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source ELSE 'all' END AS value,
             count(*) AS total, count(*) FILTER (has_pseudo) AS pseudo_label_available, count(*) FILTER (mapped) AS mapped_true_keypress, count(*) FILTER (mapped AND has_pseudo) AS comparable,
             count(*) FILTER (mapped AND has_pseudo AND same) AS exact, count(*) FILTER (mapped AND has_pseudo AND (same OR north)) AS equivalent FROM r GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT *, CASE WHEN comparable = 0 THEN 0.0 ELSE exact::DOUBLE / comparable END AS exact_rate, CASE WHEN comparable = 0 THEN 0.0 ELSE equivalent::DOUBLE / comparable END AS equivalent_rate FROM (SELECT dimension, value, total, pseudo_label_available, mapped_true_keypress, comparable, exact, equivalent FROM g)
""")
def label_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as true keys, text length as a pseudo label: counts over all and by language and source."""
    labelled = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, sf_dir, "documents").join(labelled, "doc_id", "left").withColumns(
        {
            "n_actions": F.when(F.col("quality").isNull(), F.lit(None).cast("int")).when(F.col("toxic") == 1, 2).otherwise(1),
            "true_action_id": F.col("quality"),
            "true_action_name": F.when(F.col("quality") == 1, "CompassDirection.N").otherwise("Command.WAIT"),
            "pseudo_action_id": F.when(F.col("n_chars") >= 200, (F.col("n_chars") > 1000).cast("int")),
            "pseudo_direction": F.lit("N"),
        }
    )
    return labels.label_audit(labels.audited(rows), ["lang", "source"])


@registered("""
WITH c AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), p AS (SELECT conv_id, turn, a, b FROM c WHERE b IS NOT NULL AND a IS NOT NULL),
x AS (SELECT conv_id, greatest(length(a), length(b)) AS total, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: substr(a, k, 1) = substr(b, k, 1))) AS same FROM p)
SELECT conv_id, count(*) AS n_pairs, sum(same)::BIGINT AS matching, sum(total)::BIGINT AS total, round(sum(same)::DOUBLE / sum(total), 6) AS char_accuracy FROM x GROUP BY 1
""")
def char_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transitions.pair_next(table(spark, sf_dir, "conversations"), "text", lane=["conv_id"], order=["turn"]).filter("next_value IS NOT NULL AND text IS NOT NULL")
    own = rows.select("conv_id", frames.matching_characters(F.col("text"), F.col("next_value")).alias("same"), frames.longest_length(F.col("text"), F.col("next_value")).alias("n"))
    return own.groupBy("conv_id").agg(F.count("*").alias("n_pairs"), F.sum("same").cast("long").alias("matching"), F.sum("n").cast("long").alias("total"), F.round(scalars.rate(F.sum("same"), F.sum("n")), 6).alias("char_accuracy"))


def framed(text: str) -> F.Column:
    """A text as a frame: all of it as map, its first line as message, its length as numbers."""
    x = F.coalesce(F.col(text), F.lit(""))
    return F.concat(F.lit("MAP:\n"), x, F.lit("\nMESSAGE:\n"), F.substring_index(x, "\n", 1), F.lit("\nBLSTATS:\n["), F.length(x).cast("string"), F.lit(", 1]\nINVENTORY:\n<empty>"))


@registered("""
WITH c AS (SELECT conv_id, role, coalesce(text, '') AS a, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT role, count(*) AS n, count(*) FILTER (split_part(a, chr(10), 1) = split_part(b, chr(10), 1)) AS message_exact, count(*) FILTER (a = b) AS map_exact, count(*) FILTER (length(a) = length(b)) AS blstats_exact,
       sum(length(split_part(a, chr(10), 1)))::BIGINT AS message_chars FROM c WHERE b IS NOT NULL GROUP BY 1
""")
def section_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns rendered as frames, each compared with the next by section."""
    rows = table(spark, sf_dir, "conversations").withColumn("frame", framed("text"))
    rows = transitions.pair_next(rows, "frame", lane=["conv_id"], order=["turn"]).filter("next_value IS NOT NULL")
    same = lambda h: F.count_if(frames.section(F.col("frame"), h) == frames.section(F.col("next_value"), h))
    return rows.groupBy("role").agg(
        F.count("*").alias("n"), same("MESSAGE:").alias("message_exact"), same("MAP:").alias("map_exact"), same("BLSTATS:").alias("blstats_exact"), F.sum(F.length(frames.section(F.col("frame"), "MESSAGE:"))).alias("message_chars")
    )


@registered("""
WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), w AS (SELECT a.conv_id, a.turn AS start, a.text AS prediction, b.turn - a.turn AS "offset", b.text AS label FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 0 AND 2
  JOIN r c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2 JOIN r d ON a.conv_id = d.conv_id AND d.turn = a.turn + 1)
SELECT "offset"::INTEGER AS "offset", count(*) AS n_frames, count(*) FILTER (prediction = label) AS exact,
       sum(len(list_filter(range(1, least(length(prediction), length(label)) + 1), lambda k: substr(prediction, k, 1) = substr(label, k, 1))))::BIGINT AS matching, sum(greatest(length(prediction), length(label)))::BIGINT AS total FROM w GROUP BY 1
""")
def copy_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("frame", F.coalesce("text", F.lit("")))
    windows = metrics.copy_baseline(rows, sequence="conv_id", step="turn", frame="frame", horizon=3)
    same, total = frames.matching_characters(F.col("prediction"), F.col("label")), frames.longest_length(F.col("prediction"), F.col("label"))
    return windows.groupBy("offset").agg(F.count("*").alias("n_frames"), F.count_if(F.col("prediction") == F.col("label")).alias("exact"), F.sum(same).alias("matching"), F.sum(total).cast("long").alias("total"))


@registered("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INTEGER) AS s FROM embeddings), t AS (SELECT a.s AS c, b.s AS t, d.s AS p FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v d ON d.vec_id = a.vec_id + 2),
x AS (SELECT unnest(range(1, len(c) + 1)) AS k, c, t, p FROM t), y AS (SELECT k, c[k] AS c, t[k] AS t, p[k] AS p FROM x),
z AS (SELECT (SELECT count(*) FROM t) AS examples, count(*) AS cells, count(*) FILTER (p = t) AS char_correct, (SELECT count(*) FROM t WHERE p = t) AS exact_frames, count(*) FILTER (t <> c) AS true_changed, count(*) FILTER (p <> c) AS predicted_changed,
      count(*) FILTER (t <> c AND p = t) AS correct_changed, count(*) FILTER (t <> c AND p <> c) AS true_positive_changed, count(*) FILTER (k <= 48 AND p = t) AS map_char_correct, count(*) FILTER (k <= 48) AS map_cells, count(*) FILTER (k > 48 AND p = t) AS status_char_correct, count(*) FILTER (k > 48) AS status_cells FROM y)
SELECT *, round(char_correct::DOUBLE / cells, 6) AS char_accuracy, round(exact_frames::DOUBLE / examples, 6) AS exact_frame_rate, round(true_positive_changed::DOUBLE / predicted_changed, 6) AS changed_cell_precision, round(true_positive_changed::DOUBLE / true_changed, 6) AS changed_cell_recall,
       round(2.0::DOUBLE * (true_positive_changed::DOUBLE / predicted_changed) * (true_positive_changed::DOUBLE / true_changed) / (true_positive_changed::DOUBLE / predicted_changed + true_positive_changed::DOUBLE / true_changed), 6) AS changed_cell_f1,
       round(correct_changed::DOUBLE / true_changed, 6) AS changed_cell_char_accuracy, round(map_char_correct::DOUBLE / map_cells, 6) AS map_char_accuracy, round(status_char_correct::DOUBLE / status_cells, 6) AS status_char_accuracy FROM z
""")
def plane_changed_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of embeddings as planes of 64 cells: a row, the next as truth, the one after as prediction."""
    planes = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("s"))
    shifted = lambda k, n: planes.select((F.col("vec_id") - k).alias("vec_id"), F.col("s").alias(n))
    rows = shifted(0, "c").join(shifted(1, "t"), "vec_id").join(shifted(2, "p"), "vec_id")
    return metrics.plane_metrics(rows.select(*metrics.plane_sums(F.col("c"), F.col("t"), F.col("p"), 48)))


@registered()
def message_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the messages of turns that follow each other, a turn's message being its first line as in a frame (tested against difflib)."""
    rows = table(spark, sf_dir, "conversations").withColumn("m", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    rows = transitions.pair_next(rows, "m", lane=["conv_id"], order=["turn"]).filter("next_value IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(similarity_ratio("m", "next_value"), 6).alias("similarity"))


# Comparison and gates


@registered(f"""
WITH {METRICS_SQL} SELECT count(*) AS metric_count, count(*) FILTER (improved) AS improved_count, count(*) FILTER (regressed) AS regressed_count,
  CASE WHEN count(*) FILTER (improved) > 0 AND count(*) FILTER (regressed) = 0 THEN 'improved' WHEN count(*) FILTER (regressed) > 0 AND count(*) FILTER (improved) = 0 THEN 'regressed' WHEN count(*) FILTER (improved OR regressed) > 0 THEN 'mixed' ELSE 'unchanged' END AS verdict FROM g
""")
def score_to_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.score_to_beat(_compared(spark, sf_dir))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tables.event_metrics(spark, sf_dir)
    return compare.compared(runs.filter("run = 'baseline'"), runs.filter("run = 'trained'"))


@registered(f"WITH {METRICS_SQL} SELECT metric, baseline, trained, delta, direction, improved, regressed FROM g")
def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


@registered(f"""
WITH {METRICS_SQL}, q AS (SELECT * FROM (VALUES ('exact', 'exact_match_rate', 'improved'), ('chars', 'next_frame_char_accuracy', 'not_regressed'), ('windows', 'next_1_frame_sequence_window_count', 'positive_trained_value'), ('mae', 'next_frame_blstats_numeric_mae', 'not_regressed'), ('nll', 'next_frame_teacher_forced_mean_nll', 'improved')) v(name, metric, mode)),
s AS (SELECT CASE WHEN trained IS NULL THEN 'missing' WHEN CASE mode WHEN 'improved' THEN improved WHEN 'not_regressed' THEN NOT regressed ELSE trained > 0 END THEN 'passed' ELSE 'failed' END AS status FROM q LEFT JOIN g USING (metric))
SELECT count(*) AS requirement_count, count(*) FILTER (status = 'passed') AS passed_count, count(*) FILTER (status = 'failed') AS failed_count, count(*) FILTER (status = 'missing') AS missing_count,
       CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'missing') > 0 THEN 'missing' ELSE 'passed' END AS verdict FROM s
""")
def proof_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [
        ("exact", "exact_match_rate", "improved"),
        ("chars", "next_frame_char_accuracy", "not_regressed"),
        ("windows", "next_1_frame_sequence_window_count", "positive_trained_value"),
        ("mae", "next_frame_blstats_numeric_mae", "not_regressed"),
        ("nll", "next_frame_teacher_forced_mean_nll", "improved"),
    ]
    return compare.gate(compare.requirements(spark.createDataFrame(wanted, "name string, metric string, mode string"), _compared(spark, sf_dir)))


@registered("""
WITH r AS (SELECT item_id::VARCHAR AS benchmark_id, item_id % 3 AS k, length(text) AS n FROM benchmark), c AS (SELECT count(*)::DOUBLE AS estimate, count(*)::DOUBLE / 2 AS lower FROM documents)
SELECT benchmark_id, CASE WHEN k = 0 THEN 'reference_only' WHEN k = 1 AND lower >= n THEN 'passed' WHEN k = 2 AND lower >= n / 2.0::DOUBLE THEN 'passed' ELSE 'failed' END AS status,
       CASE k WHEN 1 THEN n::DOUBLE WHEN 2 THEN n / 2.0::DOUBLE END AS threshold, CASE WHEN k <> 0 THEN CASE WHEN k = 1 THEN lower >= n ELSE lower >= n / 2.0::DOUBLE END END AS passed FROM r, c
""")
def benchmark_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as external targets of kinds by id; the candidate's interval comes from the documents."""
    size = F.length("text").cast("double")
    registry = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("benchmark_id"), F.lit("lane").alias("lane"), F.lit("p").alias("protocol_id"), F.lit("count").alias("candidate_metric"), (F.col("item_id") % 3 == 1).alias("required_for_competitive"),
        F.when(F.col("item_id") % 3 == 0, "reference_only").when(F.col("item_id") % 3 == 1, "candidate_lower_at_least_target_estimate").otherwise("candidate_lower_at_least_target_lower").alias("comparison"),
        F.struct(size.alias("estimate"), (size / 2).alias("lower")).alias("target"),
    )
    candidate = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("estimate")).select(F.lit("count").alias("metric"), "estimate", (F.col("estimate") / 2).alias("lower"))
    return compare.benchmark_comparison(registry, candidate, ["p"]).select("benchmark_id", "status", "threshold", "passed")


@registered("""
WITH m AS (SELECT user_id % 5 AS run, event_type AS metric, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2)
SELECT metric, count(*) AS runs, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, min(value) AS min, max(value) AS max FROM m GROUP BY 1
""")
def run_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("run"), F.col("event_type").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return compare.spread(runs).withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


# Rollouts

SUMMARY_SQL = f"""
WITH {WATCH_SQL}, a AS (SELECT seed, side, max(n) AS mode_count FROM (SELECT seed, side, action_id, count(*) AS n FROM f WHERE action_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
b AS (
  SELECT seed, side, count(*) AS event_count, count(action_id) AS step_count, arg_max(cumulative_reward, step) AS cumulative_reward,
         arg_min(score, step) FILTER (score IS NOT NULL) AS score_initial, arg_max(score, step) FILTER (score IS NOT NULL) AS score_final, arg_max(coalesce(death, ''), step) AS last_death,
         arg_min(depth, step) AS depth_initial, max(depth) AS depth_max, count(*) FILTER (wall) AS wall_message_count, count(*) FILTER (bad) AS bad_message_count,
         count(*) FILTER (still AND action_id IS NOT NULL) AS non_advancing_step_count, count(*) FILTER (hungry) AS hunger_warning_count, count(*) FILTER (starving) AS starvation_or_faint_count,
         count(*) FILTER (prompted) AS menu_or_prompt_step_count, count(*) FILTER (stuck) AS stuck_menu_or_prompt_loop_count, count(*) FILTER (raw) AS raw_count, count(*) FILTER (raw AND NOT dirty) AS clean_count, count(*) FILTER (raw AND dirty) AS dirty_count
  FROM f GROUP BY ALL
), z AS (
  SELECT b.*, coalesce(mode_count, 0) AS mode_count, (score_final - score_initial)::DOUBLE AS score_delta, greatest(0, depth_max - depth_initial) AS depth_delta,
         greatest(0, coalesce(mode_count, 0) - CASE WHEN step_count > 0 THEN greatest(1, floor(step_count * 0.75)::BIGINT) ELSE 0 END) AS collapse_excess,
         CASE WHEN step_count = 0 THEN 0 ELSE coalesce(mode_count, 0)::DOUBLE / step_count END AS repeat_rate
  FROM b LEFT JOIN a USING (seed, side)
), y AS (
  SELECT *, coalesce(score_delta, cumulative_reward) AS fit_delta, CASE WHEN step_count = 0 THEN 0.0 ELSE 1.0::DOUBLE / step_count END AS per FROM z
), v AS (
  SELECT *, (step_count > 0 AND cumulative_reward <= 0 AND fit_delta <= 0 AND depth_delta <= 0 AND raw_count = 0)::INTEGER AS zero_progress FROM y
), u AS (
  SELECT *, round(sign(fit_delta) * ln(1 + abs(fit_delta)) + 0.25::DOUBLE * sign(cumulative_reward) * ln(1 + abs(cumulative_reward)) + 3 * depth_delta + 0.1::DOUBLE * least(clean_count, 5) + 0.5::DOUBLE * clean_count
           - CASE WHEN last_death <> '' THEN 8 ELSE 0 END - 1.5::DOUBLE * starvation_or_faint_count - 0.1::DOUBLE * wall_message_count - 2.5::DOUBLE * wall_message_count * per - 0.1::DOUBLE * bad_message_count - 1.5::DOUBLE * bad_message_count * per
           - 0.2::DOUBLE * non_advancing_step_count - non_advancing_step_count * per - 0.05::DOUBLE * collapse_excess - 2 * greatest(0, repeat_rate - 0.5::DOUBLE) - 1.5::DOUBLE * menu_or_prompt_step_count * per
           - 0.5::DOUBLE * stuck_menu_or_prompt_loop_count - dirty_count - 3 * zero_progress, 6) AS fitness_score FROM v
)
"""
SUMMARY_COUNTS = ("event_count", "step_count", "wall_message_count", "bad_message_count", "non_advancing_step_count", "hunger_warning_count", "starvation_or_faint_count", "menu_or_prompt_step_count", "stuck_menu_or_prompt_loop_count")


@registered(f"""
{SUMMARY_SQL} SELECT seed, side, {', '.join(SUMMARY_COUNTS)}, cumulative_reward, score_delta::BIGINT AS score_delta, depth_delta::INTEGER AS depth_delta, mode_count AS action_mode_count, raw_count AS raw_live_progress_event_count, clean_count AS live_progress_event_count, dirty_count AS dirty_live_progress_event_count, zero_progress AS zero_progress_episode FROM u
""")
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollouts.summaries(tables.watch_events(spark, sf_dir))
    more = ("cumulative_reward", "action_mode_count", "raw_live_progress_event_count", "live_progress_event_count", "dirty_live_progress_event_count", "zero_progress_episode")
    return out.select("seed", "side", *SUMMARY_COUNTS, F.col("score_delta").cast("long").alias("score_delta"), F.col("depth_delta").cast("int").alias("depth_delta"), *more)


@registered(f"""
{SUMMARY_SQL} SELECT seed, side, fitness_score, round(sign(fit_delta) * ln(1 + abs(fit_delta)), 6) AS score_term, round(-2.5::DOUBLE * wall_message_count * per, 6) AS wall_rate_term FROM u
""")
def fitness_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollouts.summaries(tables.watch_events(spark, sf_dir))
    part = lambda n: F.round(F.col(f"fitness_components.{n}"), 6)
    return out.select("seed", "side", F.round("fitness_score", 6).alias("fitness_score"), part("normalized_score_delta").alias("score_term"), part("wall_message_rate").alias("wall_rate_term"))


DELTAS = ("cumulative_reward", "score_delta", "bad_message_count", "live_progress_event_count")


@registered(f"""
{SUMMARY_SQL} SELECT c.seed, c.cumulative_reward - b.cumulative_reward AS cumulative_reward, coalesce(c.score_delta - b.score_delta, 0) AS score_delta, (c.bad_message_count - b.bad_message_count)::DOUBLE AS bad_message_count, (c.clean_count - b.clean_count)::DOUBLE AS live_progress_event_count
FROM u c JOIN u b USING (seed) WHERE c.side = 'current' AND b.side = 'baseline'
""")
def side_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.side_deltas(rollouts.summaries(tables.watch_events(spark, sf_dir)), DELTAS).drop("run_id")


@registered(f"""
{SUMMARY_SQL} SELECT side, count(*) AS seed_count, round(avg(cumulative_reward), 6) AS cumulative_reward, round(avg(score_delta), 6) AS score_delta, round(avg(bad_message_count), 6) AS bad_message_count, round(avg(clean_count), 6) AS live_progress_event_count FROM u GROUP BY 1
""")
def sweep_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollouts.sweep_means(rollouts.summaries(tables.watch_events(spark, sf_dir)), DELTAS, ["side"])
    return out.withColumns({m: F.round(m, 6) for m in DELTAS})


SIMILARITY_SQL = f"""
WITH {EVENTS_SQL}, s AS (SELECT user_id, count(*) AS n, list(action_id ORDER BY step) AS a FROM e GROUP BY 1),
k AS (SELECT count(*) AS c FROM s GROUP BY n, a), t AS (SELECT sum(c) * (sum(c) - 1) / 2 AS pairs, sum(c * (c - 1) / 2) AS equal FROM k),
p AS (SELECT step, action_id, n, count(*) AS c FROM e JOIN s USING (user_id) GROUP BY ALL),
m AS (SELECT n, c * coalesce(sum(c) OVER (PARTITION BY step, action_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + c * (c - 1) / 2 AS met FROM p)
SELECT pairs::BIGINT AS pair_count, equal::BIGINT AS equal_pairs, round(equal::DOUBLE / pairs, 6) AS identity_rate, round((SELECT sum(met::DOUBLE / n) FROM m) / pairs, 6) AS mean_similarity FROM t
"""


@registered(SIMILARITY_SQL)
def sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of all actions of all users."""
    return rollouts.step_similarity(tables.event_steps(spark, sf_dir), key="user_id", place="step", action="action_id")


@registered(SIMILARITY_SQL)
def whole_sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the name it had while sequence_similarity was cut."""
    return sequence_similarity(spark, sf_dir)


@registered(f"WITH {WATCH_SQL} SELECT seed, side, count(*) FILTER (stuck) AS stuck, count(*) FILTER (prompted) AS prompts FROM f GROUP BY ALL")
def stuck_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import events

    rows = tables.watch_events(spark, sf_dir)
    told = rollouts.stuck_loops(rows, episode=["seed", "side"], order="step", prompt=events.is_prompt(), signature=F.struct("action_id", F.lower(F.coalesce("message", F.lit(""))).alias("m")))
    return told.groupBy("seed", "side").agg(F.count_if("stuck").alias("stuck"), F.count_if(events.is_prompt()).alias("prompts"))


@registered(f"WITH {WATCH_SQL} SELECT seed, side, count(*) FILTER (raw) AS raw, count(*) FILTER (raw AND NOT dirty) AS clean, count(*) FILTER (raw AND dirty) AS dirty FROM f GROUP BY ALL")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import events

    told = rollouts.progress_flags(tables.watch_events(spark, sf_dir), episode=["seed", "side"], order="step", dirty=events.is_dirty())
    return told.groupBy("seed", "side").agg(F.count_if("raw_progress").alias("raw"), F.count_if("clean_progress").alias("clean"), F.count_if("dirty_progress").alias("dirty"))


@registered(f"""
WITH {WATCH_SQL}, g AS (
  SELECT seed, side, step, action_id, prompt, coalesce(score - 50, 0)::DOUBLE AS s, greatest(0, depth - 2)::DOUBLE AS d, greatest(0, prompt_hp - hp)::DOUBLE AS hurt, reward, wall, bad, prompted, starving, still AND action_id IS NOT NULL AS still, death IS NOT NULL AS died FROM f
), h AS (SELECT *, reward > 0 OR s > 0 OR d > 0 AS raw FROM g), i AS (SELECT *, raw AND (wall OR bad OR still OR prompted OR died) AS dirty FROM h),
j AS (
  SELECT *, sign(s) * ln(1 + abs(s)) + 0.25::DOUBLE * ln(1 + reward) + 3 * d + 0.1::DOUBLE * (action_id IS NOT NULL AND raw AND NOT (wall OR bad OR still OR prompted))::INTEGER + 0.5::DOUBLE * (raw AND NOT dirty)::INTEGER - 0.5::DOUBLE * hurt
         - 2.6::DOUBLE * wall::INTEGER - 1.6::DOUBLE * bad::INTEGER - 1.2::DOUBLE * still::INTEGER - 2.0::DOUBLE * prompted::INTEGER - 1.5::DOUBLE * starving::INTEGER - dirty::INTEGER - 3 * (NOT raw)::INTEGER - 8 * died::INTEGER AS value,
         raw AND NOT dirty AS positive, hurt > 0 OR wall OR bad OR still OR starving OR prompted OR died AS poor FROM i
), k AS (
  SELECT c.*, b.action_id AS b_action, b.prompt AS b_prompt, b.value AS b_value, b.positive AS b_positive, b.poor AS b_poor FROM j c JOIN j b ON c.seed = b.seed AND c.step = b.step AND c.side = 'current' AND b.side = 'baseline'
), l AS (
  SELECT seed, step, CASE WHEN action_id IS NULL OR b_action IS NULL THEN 'missing_action' WHEN action_id = b_action THEN 'same_action' WHEN prompt IS NULL OR b_prompt IS NULL THEN 'missing_prompt' WHEN prompt <> b_prompt THEN 'divergent_prompt'
         WHEN round(abs(value - b_value), 9) < 0.05 THEN 'utility_tie' WHEN NOT CASE WHEN value > b_value THEN positive OR (b_poor AND NOT poor) ELSE b_positive OR (poor AND NOT b_poor) END THEN 'low_quality_preference' END AS skip_reason,
         CASE WHEN value > b_value THEN 'current' ELSE 'baseline' END AS side, round(abs(value - b_value), 6) AS margin, CASE WHEN value > b_value THEN action_id ELSE b_action END AS good FROM k
)
SELECT seed, step::INTEGER AS step, skip_reason, CASE WHEN skip_reason IS NULL THEN side END AS chosen_side, CASE WHEN skip_reason IS NULL THEN '{{"action_id": ' || good || '}}' END AS chosen, CASE WHEN skip_reason IS NULL THEN margin END AS utility_margin FROM l
""")
def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.preferences(tables.watch_events(spark, sf_dir)).select("seed", "step", "skip_reason", "chosen_side", "chosen", F.round("utility_margin", 6).alias("utility_margin"))


@registered(f"""
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {bucket_sql(SEED, 'doc_id')}, doc_id) AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents),
p AS (SELECT a.doc_id, a.lang, a.source, arg_min(b.doc_id, (b.n - a.n + a.c) % a.c) AS other_key FROM r a JOIN r b ON a.lang = b.lang AND a.source <> b.source GROUP BY ALL)
SELECT p.doc_id, p.lang, p.other_key, d.source AS other_label FROM p JOIN documents d ON d.doc_id = p.other_key
""")
def circular_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return compare.shuffled_pairs(rows, group=["lang"], key="doc_id", label="source", seed=SEED).select("doc_id", "lang", "other_key", "other_label")


# Ledgers

STATES = {"click": "uploaded", "error": "failed", "purchase": "uploaded_again", "signup": "timeout", "view": "deferred"}
STATES_SQL = "u AS (SELECT user_id AS name, event_id AS ordinal, CASE event_type WHEN 'click' THEN 'uploaded' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'uploaded_again' WHEN 'signup' THEN 'timeout' ELSE 'deferred' END AS status FROM events)"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.lit(v))])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("ordinal"), F.try_element_at(states, F.col("event_type")).alias("status"))


@registered(f"WITH {STATES_SQL} SELECT name, arg_max(status, ordinal) AS status FROM u GROUP BY 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_status(uploads(spark, sf_dir))


@registered(f"WITH {STATES_SQL} SELECT DISTINCT name FROM u WHERE status LIKE 'uploaded%' OR status IN ('timeout', 'deferred')")
def resumable_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.resumable_skips(uploads(spark, sf_dir))


@registered(f"""
WITH {EVENTS_SQL}, l AS (SELECT *, k < last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fell FROM e)
SELECT user_id, count(*) AS event_count, count(*) FILTER (fell) AS restart_count, coalesce(max(k), 0) AS max_k FROM l GROUP BY 1
""")
def ledger_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.restarts(tables.event_steps(spark, sf_dir), "k", key=["user_id"], order="event_id")


@registered(f"WITH {STATES_SQL} SELECT name, arg_max(status, ordinal) AS status FROM u GROUP BY 1")
def streaming_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """latest_status as a stream over the events table, run until all there is was read."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    states = F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.lit(v))])
    rows = source.select(F.col("user_id").alias("name"), F.col("event_id").alias("ordinal"), F.try_element_at(states, F.col("event_type")).alias("status"))
    return ledger.run_to_end(ledger.latest_status(rows), ["name"])


from . import audit_queries, build_queries, frame_queries, report_queries, run_queries  # noqa: E402, F401  (they register themselves)
