"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import build, splits, transitions

SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def day(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces: ordinal, gameid, step, raw_key (role), observation_text, next_value, split, n_actions, action_id."""
    return steps_of(table(spark, sf_dir, "conversations"))


def steps_of(conversations: DataFrame) -> DataFrame:
    spark, more = conversations.sparkSession, [c for c in ("shard_index",) if c in conversations.columns]
    rows = conversations.select(
        F.col("conv_id").alias("gameid"), F.col("turn").alias("step"), F.col("role").alias("raw_key_code"), F.col("text").alias("observation_text"), (F.col("conv_id") * 100000 + F.col("turn")).alias("ordinal"), *more
    )
    paired = transitions.pair_next(rows, "observation_text", lane=["gameid"], order=["step"])
    split = splits.with_split(paired, "gameid", SEED)
    keys = spark.createDataFrame([("user", 0), ("assistant", 1), ("tool", 2)], "raw_key_code string, action_id int")
    return build.with_action(split, build.key_map(keys))


#: conversation_steps in SQL
STEPS_SQL = """
c AS (
  SELECT conv_id AS gameid, turn AS step, role, text, conv_id * 100000 + turn AS ordinal,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
         ('0x' || substr(sha256('7:' || conv_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS bucket
  FROM conversations
), s AS (
  SELECT *, CASE WHEN bucket < 0.9::DOUBLE THEN 'train' WHEN bucket < 0.9::DOUBLE + 0.05::DOUBLE THEN 'validation' ELSE 'test' END AS split,
         CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'tool' THEN 2 END AS action_id
  FROM c
), t AS (
  SELECT s.*, 'policy_action' AS task, CASE WHEN action_id IS NULL THEN 'unmapped_raw_key_code' END AS reason FROM s
  UNION ALL
  SELECT s.*, 'next_frame', CASE WHEN action_id IS NULL THEN 'unmapped_raw_key_code' WHEN next_text IS NULL THEN 'missing_next_observation' END FROM s
)
"""


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``step`` (from 1 per user, by time), ``action_id`` (types by name) and ``k`` of the props."""
    rows = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    actions = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumns({"step": F.row_number().over(w), "action_id": F.try_element_at(actions, F.col("event_type")), "k": F.get_json_object("props", "$.k").cast("int")})


ACTIONS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
EVENTS_SQL = """
e AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS action_id,
         (props::JSON ->> '$.k')::INTEGER AS k
  FROM events
)
"""
MESSAGES = {"click": "You see here a wall.", "error": "You cannot do that.", "purchase": "You feel wise.", "signup": "What do you want to call it?", "view": "Nothing to see."}


def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rollouts: users are seeds in pairs (even: current, odd: baseline), values rewards, k scores."""
    e = event_steps(spark, sf_dir)
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    message = F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    text = lambda v: F.lit(v).cast("string")
    # cents as whole numbers: sums of rewards are then the same in any order
    return e.select(
        F.lit("run").alias("run_id"),
        F.floor(F.col("user_id") / 2).cast("long").alias("seed"),
        F.when(F.col("user_id") % 2 == 0, "current").otherwise("baseline").alias("side"),
        "step",
        F.when(F.col("k") % 10 != 9, F.col("action_id")).alias("action_id"),
        F.when(F.col("event_type") == "purchase", F.round(F.col("value")).cast("double")).otherwise(0.0).alias("reward"),
        F.sum(F.when(F.col("event_type") == "purchase", F.round(F.col("value")).cast("double")).otherwise(0.0)).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cumulative_reward"),
        F.lit(False).alias("done"),
        F.when((F.col("event_type") == "error") & (F.col("k") % 50 == 0), "killed by an error").alias("death"),
        F.when(F.col("k") % 7 != 0, F.col("k")).alias("score"),
        (F.lit(100) - F.col("k")).alias("hp"),
        F.floor(F.col("k") / 25).cast("int").alias("depth"),
        F.when(F.col("k") % 3 == 0, F.lit(100) - F.col("k")).otherwise(100).alias("prompt_hp"),
        F.lit(50).alias("prompt_score"),
        F.lit(2).alias("prompt_depth"),
        F.try_element_at(message, F.col("event_type")).alias("message"),
        F.when(F.col("k") % 20 == 1, "Hungry").when(F.col("k") % 20 == 2, "Fainting").alias("hunger"),
        (F.col("k") % 30 == 0).alias("menu_open"),
        (F.col("k") % 4 != 0).alias("game_time_advanced"),
        text(None).alias("terminal_frame"),
        text(None).alias("prompt_terminal_frame"),
        text(None).alias("policy_observation_text"),
        F.when(F.col("k") % 13 != 0, F.concat(F.lit("prompt "), (F.col("step") % 5).cast("string"))).alias("policy_user_prompt"),
    )


WATCH_SQL = EVENTS_SQL + """
, w AS (
  SELECT user_id // 2 AS seed, CASE WHEN user_id % 2 = 0 THEN 'current' ELSE 'baseline' END AS side, step,
         CASE WHEN k % 10 <> 9 THEN action_id END AS action_id,
         CASE WHEN event_type = 'purchase' THEN round(value) ELSE 0.0 END::DOUBLE AS reward,
         CASE WHEN event_type = 'error' AND k % 50 = 0 THEN 'killed by an error' END AS death,
         CASE WHEN k % 7 <> 0 THEN k END AS score, 100 - k AS hp, k // 25 AS depth,
         CASE WHEN k % 3 = 0 THEN 100 - k ELSE 100 END AS prompt_hp,
         CASE event_type WHEN 'click' THEN 'you see here a wall.' WHEN 'error' THEN 'you cannot do that.' WHEN 'purchase' THEN 'you feel wise.'
              WHEN 'signup' THEN 'what do you want to call it?' WHEN 'view' THEN 'nothing to see.' END AS message,
         k % 20 = 1 AS hungry, k % 20 = 2 AS starving, k % 4 = 0 AS still,
         k % 30 = 0 OR event_type = 'signup' AS prompted,
         CASE WHEN k % 13 <> 0 THEN 'prompt ' || (step % 5) END AS prompt
  FROM e
), x AS (
  SELECT *, message LIKE '%wall%' AS wall, message LIKE '%wall%' OR prompted OR message LIKE '%you cannot%' AS bad,
         sum(reward) OVER (PARTITION BY seed, side ORDER BY step ROWS UNBOUNDED PRECEDING) AS cumulative_reward,
         last_value(CASE WHEN action_id IS NOT NULL THEN score END IGNORE NULLS) OVER (PARTITION BY seed, side ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_score,
         last_value(CASE WHEN action_id IS NOT NULL THEN depth END IGNORE NULLS) OVER (PARTITION BY seed, side ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_depth,
         lag(prompted) OVER o AS was_prompted, lag(action_id) OVER o AS was_action, lag(message) OVER o AS was_message
  FROM w WINDOW o AS (PARTITION BY seed, side ORDER BY step)
), f AS (
  SELECT *, action_id IS NOT NULL AND (reward > 0 OR coalesce(score > last_score, false) OR coalesce(depth > last_depth, false)) AS raw,
         bad OR still OR death IS NOT NULL AS dirty,
         prompted AND coalesce(was_prompted, false) AND was_action IS NOT DISTINCT FROM action_id AND was_message IS NOT DISTINCT FROM message AS stuck
  FROM x
)
"""


def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by half of the events (by event_id) as (run, metric, value): shares of each type and a count."""
    rows = table(spark, sf_dir, "events").withColumn("run", F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("trained"))
    total = rows.groupBy("run").agg(F.count("*").alias("n"), *[F.count_if(F.col("event_type") == t).alias(t) for t in ACTIONS], F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    ratio = lambda c: F.round(scalars.rate(F.col(c), F.col("n")), 6)
    pairs = [("exact_match_rate", ratio("click")), ("parse_valid_rate", ratio("purchase")), ("next_frame_char_accuracy", ratio("view")), ("next_frame_blstats_numeric_mae", F.round(F.col("cents") / 100 / F.col("n"), 6)), ("next_1_frame_sequence_window_count", F.col("error").cast("double"))]
    return total.select("run", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in pairs])).alias("p")).select("run", "p.*")


METRICS_SQL = """
r AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'trained' END AS run, count(*) AS n,
         count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
         count(*) FILTER (event_type = 'view') AS view_, sum(round(value * 100)::BIGINT)::BIGINT AS cents
  FROM events GROUP BY 1
), m AS (
  SELECT run, 'exact_match_rate' AS metric, round(click::DOUBLE / n, 6) AS value FROM r
  UNION ALL SELECT run, 'parse_valid_rate', round(purchase::DOUBLE / n, 6) FROM r
  UNION ALL SELECT run, 'next_frame_char_accuracy', round(view_::DOUBLE / n, 6) FROM r
  UNION ALL SELECT run, 'next_frame_blstats_numeric_mae', round(cents / 100.0::DOUBLE / n, 6) FROM r
  UNION ALL SELECT run, 'next_1_frame_sequence_window_count', error::DOUBLE FROM r
), d AS (
  SELECT b.metric, b.value AS baseline, t.value AS trained, round(t.value - b.value, 12) AS delta,
         CASE WHEN b.metric LIKE '%_mae' THEN 'lower_is_better' ELSE 'higher_is_better' END AS direction
  FROM m b JOIN m t USING (metric) WHERE b.run = 'baseline' AND t.run = 'trained'
), g AS (
  SELECT *, CASE WHEN direction = 'lower_is_better' THEN delta < 0 ELSE delta > 0 END AS improved,
         CASE WHEN direction = 'lower_is_better' THEN delta > 0 ELSE delta < 0 END AS regressed
  FROM d
)
"""
