"""Queries of audits, labels, builds and their limits, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import frames
from ..operators import audit, build, history, labels, splits, training
from ..sources import readers, writers
from ..streaming import ledger
from . import queries as base
from . import tables
from .registry import bucket_sql, registered, split_sql
from .tables import SEED, table

#: Keys 0, 1 and 3 have one action, key 2 has two, key 4 none.
KEYS = [(0, 0), (1, 1), (2, 2), (2, 4), (3, 3)]
VALID = (0, 1, 2, 3)


def defective_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as supervised rows with all kinds of defects, by residues of conversation and turn."""
    c, t = F.col("conv_id"), F.col("turn")
    each = lambda x, n, k=0: x % n == k
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = splits.with_split(rows, "conv_id", SEED).withColumns(
        {
            "task_dir": F.when(each(t, 2), "policy_action").otherwise("next_frame"),
            "split_dir": F.when(each(c, 13), "test").otherwise(F.col("split")),
            "key": (t % 5).cast("int"),
            "target": (t % 5 + each(t, 10, 8).cast("int")).cast("int"),
        }
    )
    action = lambda x: F.concat(F.lit('{"action_id": '), x.cast("string"), F.lit("}"))
    user = F.concat(F.lit("Action taken: "), action(F.col("target") + each(t, 21, 5).cast("int")), F.lit("\nCurrent observation:\n"), F.col("text"))
    frame = F.when(each(t, 6, 1), F.col("text")).otherwise(F.concat(F.lit("MAP:\n"), F.col("text"), F.lit("\nMESSAGE:\nBLSTATS:\n"), F.when(each(t, 25, 7), "").otherwise("INVENTORY:")))
    said = F.when(each(t, 12, 10), "go north").otherwise(action(F.col("target") + each(t, 15, 14).cast("int")))
    answer = F.when(~each(c, 23), F.when(F.col("task_dir") == "policy_action", said).otherwise(frame))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    metadata = F.struct(
        F.col("key").alias("raw_key_code"),
        F.when(each(c, 31), F.array(F.lit(0), F.lit(1))).otherwise(F.array(*map(F.lit, VALID))).alias("valid_action_ids"),
        F.when(F.col("task_dir") == "policy_action", F.col("target")).alias("target_action_id"),
        F.when((F.col("task_dir") == "next_frame") & ~each(t, 9, 4), F.col("target")).alias("conditioning_action_id"),
    )
    return rows.select(
        (c * 100000 + t).alias("ordinal"),
        "split_dir",
        "task_dir",
        "split",
        F.when(each(c, 17), "policy_action").otherwise(F.col("task_dir")).alias("task"),
        F.when(~each(t, 11, 7), c).alias("gameid"),
        F.when(each(c, 19), "").otherwise(F.concat(F.lit("talk:"), c.cast("string"))).alias("episode_id"),
        F.when(each(t, 7, 6), t - 2).otherwise(t).alias("step"),
        F.lit(None).cast("string").alias("sequence_id"),
        F.lit(None).cast("int").alias("sequence_step"),
        F.array(message("system", F.lit("s")), message("user", user), message("assistant", answer)).alias("messages"),
        F.when(~each(t, 29, 3), metadata).alias("metadata"),
        F.when(each(c, 37), "{").alias("_corrupt_record"),
    )


def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = build.key_map(spark.createDataFrame(KEYS, "raw_key_code int, action_id int"))
    games = splits.with_split(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("gameid")), "gameid", SEED).filter("gameid % 41 != 0")
    return audit.failures(defective_rows(spark, sf_dir), valid_ids=VALID, keys=keys, split_games=games)


JUDGED_SQL = f"""
WITH a AS (
  SELECT conv_id AS c, turn AS t, coalesce(text, '') AS text, {split_sql(SEED, 'conv_id')} AS split, CASE WHEN turn % 2 = 0 THEN 'policy_action' ELSE 'next_frame' END AS task_dir,
         (turn % 5)::INTEGER AS key, (turn % 5 + (turn % 10 = 8)::INTEGER)::INTEGER AS target FROM conversations
), b AS (
  SELECT *, CASE WHEN c % 13 = 0 THEN 'test' ELSE split END AS split_dir, CASE WHEN c % 17 = 0 THEN 'policy_action' ELSE task_dir END AS task, t % 11 <> 7 AS has_game,
         CASE WHEN t % 7 = 6 THEN t - 2 ELSE t END AS step, CASE WHEN c % 19 = 0 THEN '' ELSE 'talk:' || c END AS episode_id, c % 37 <> 0 AS parsed, t % 29 <> 3 AS has_meta, c % 23 <> 0 AS messages_ok,
         CASE WHEN key = 2 THEN 2 WHEN key < 4 THEN 1 END AS n_actions, t % 12 <> 10 AS spoke, target + (t % 15 = 14)::INTEGER AS said, t % 9 <> 4 AS conditioned
  FROM a
), d AS (
  SELECT *, row_number() OVER (PARTITION BY task_dir, episode_id, step ORDER BY c * 100000 + t) > 1 AS repeated, parsed AND has_meta AND messages_ok AS ok, task_dir = 'policy_action' AS policy FROM b
), j AS (
  SELECT *, c * 100000 + t AS ordinal, list_filter([
    CASE WHEN NOT parsed THEN 'malformed_json_row' END,
    CASE WHEN parsed AND split <> split_dir THEN 'row_split_mismatch' END,
    CASE WHEN parsed AND task <> task_dir THEN 'row_task_mismatch' END,
    CASE WHEN parsed AND NOT has_game THEN 'row_gameid_invalid' END,
    CASE WHEN parsed AND has_game AND (c % 41 = 0 OR split <> split_dir) THEN 'row_game_missing_from_split_manifest' END,
    CASE WHEN parsed AND episode_id = '' THEN 'row_episode_id_invalid' END,
    CASE WHEN parsed AND repeated THEN 'duplicate_task_row_identity' END,
    CASE WHEN parsed AND NOT has_meta THEN 'row_metadata_invalid' END,
    CASE WHEN parsed AND has_meta AND c % 31 = 0 THEN 'row_valid_action_ids_mismatch' END,
    CASE WHEN parsed AND has_meta AND n_actions IS NULL THEN 'row_raw_key_unmapped' END,
    CASE WHEN parsed AND has_meta AND n_actions > 1 THEN 'row_raw_key_ambiguous' END,
    CASE WHEN parsed AND has_meta AND NOT messages_ok THEN 'row_messages_invalid' END,
    CASE WHEN ok AND policy AND NOT spoke THEN 'policy_action_json_invalid' END,
    CASE WHEN ok AND policy AND spoke AND target > 3 THEN 'policy_target_out_of_space' END,
    CASE WHEN ok AND policy AND spoke AND said <> target THEN 'policy_assistant_target_mismatch' END,
    CASE WHEN ok AND policy AND spoke AND n_actions = 1 AND key <> target THEN 'policy_raw_key_target_mismatch' END,
    CASE WHEN ok AND NOT policy AND NOT conditioned THEN 'next_frame_conditioning_action_missing' END,
    CASE WHEN ok AND NOT policy AND conditioned AND target > 3 THEN 'next_frame_action_out_of_space' END,
    CASE WHEN ok AND NOT policy AND conditioned AND n_actions = 1 AND key <> target THEN 'next_frame_raw_key_action_mismatch' END,
    CASE WHEN ok AND NOT policy AND conditioned AND t % 21 = 5 THEN 'next_frame_prompt_action_mismatch' END,
    CASE WHEN ok AND NOT policy AND conditioned AND CASE WHEN t % 6 = 1 THEN NOT (text LIKE '%MAP:%' AND text LIKE '%MESSAGE:%' AND text LIKE '%BLSTATS:%' AND text LIKE '%INVENTORY:%') ELSE t % 25 = 7 AND text NOT LIKE '%INVENTORY:%' END THEN 'next_frame_target_shape_invalid' END
  ], lambda x: x IS NOT NULL) AS failures FROM d
)
"""


@registered(f"""
{JUDGED_SQL}, r AS (SELECT unnest(failures) AS reason, ordinal FROM j), k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY ordinal) AS n FROM r)
SELECT reason, count(*) AS count, string_agg(ordinal, ',' ORDER BY ordinal) FILTER (n <= 5) AS examples FROM k GROUP BY 1
""")
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the defective rows by reason, with the first five of each."""
    return audit.failure_report(judged_rows(spark, sf_dir)).withColumn("examples", F.array_join("examples", ","))


@registered(f"{JUDGED_SQL} SELECT ordinal, array_to_string(failures, ',') AS failures FROM j WHERE len(failures) > 0")
def row_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_rows(spark, sf_dir).filter(F.size("failures") > 0).select("ordinal", F.array_join("failures", ",").alias("failures"))


@registered(f"""
{JUDGED_SQL} SELECT task_dir, count(*) AS n_rows, count(*) FILTER (ok AND (policy OR conditioned)) AS labelled, (sum(target) FILTER (ok AND (policy OR conditioned)))::BIGINT AS label_sum,
  count(*) FILTER (ok AND NOT policy AND conditioned AND t % 6 <> 1) AS changed FROM j GROUP BY 1
""")
def audited_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the audit reads off the rows, and next frames that differ from the current one."""
    return judged_rows(spark, sf_dir).groupBy("task_dir").agg(F.count("*").alias("n_rows"), F.count("label").alias("labelled"), F.sum("label").alias("label_sum"), F.count_if("changed").alias("changed"))


# Movement labels


def grid(values: Column) -> Column:
    """64 values as 8 lines of glyphs: the player where the largest is, a floor elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice(values, r * 8 + 1, 8), lambda x: F.when(x == F.array_max(values), labels.PLAYER_GLYPH).otherwise(46)))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames, each with the next one; the action list lacks NW and has two actions of N."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", grid(F.col("embedding")).alias("g"))
    rows = vectors.join(vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("after")), "vec_id", "left")
    names = ["N", "E", "S", "W", "NE", "SE", "SW"]
    actions = spark.createDataFrame([(k, k, f"CompassDirection.{d}", d.lower()) for k, d in enumerate(names)] + [(7, 7, "CompassDirection.N", "k"), (8, 8, "Command.WAIT", ".")], "ordinal int, action_id int, nle_action_name string, key_label string")
    return labels.with_movement_labels(rows, actions, current="g", following="after")


MOVES_SQL = """
WITH v AS (SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS p, len(list_filter(embedding, lambda x: x = list_max(embedding))) AS n FROM embeddings),
d AS (SELECT a.vec_id, CASE WHEN a.n = 1 AND b.n = 1 THEN (b.p // 8 - a.p // 8)::VARCHAR || ',' || (b.p % 8 - a.p % 8)::VARCHAR END AS delta FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, CASE delta WHEN '-1,0' THEN 'N' WHEN '0,1' THEN 'E' WHEN '1,0' THEN 'S' WHEN '0,-1' THEN 'W' WHEN '-1,1' THEN 'NE' WHEN '1,1' THEN 'SE' WHEN '1,-1' THEN 'SW' END AS pseudo_direction FROM d),
l AS (SELECT *, CASE pseudo_direction WHEN 'N' THEN 0 WHEN 'E' THEN 1 WHEN 'S' THEN 2 WHEN 'W' THEN 3 WHEN 'NE' THEN 4 WHEN 'SE' THEN 5 WHEN 'SW' THEN 6 END AS pseudo_action_id FROM m)
"""


@registered(f"{MOVES_SQL} SELECT vec_id, pseudo_direction, pseudo_action_id, 'CompassDirection.' || pseudo_direction AS pseudo_action_name, lower(pseudo_direction) AS pseudo_key_label FROM l")
def movement_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).select("vec_id", "pseudo_direction", "pseudo_action_id", "pseudo_action_name", "pseudo_key_label")


@registered(f"""
{MOVES_SQL}, s AS (SELECT *, {split_sql(SEED, '(vec_id // 50)')} AS split, 'frame ' || vec_id AS text FROM l),
a AS (SELECT *, lag(text) OVER w AS t1, lag(pseudo_action_id) OVER w AS a1 FROM s WHERE pseudo_action_id IS NOT NULL WINDOW w AS (PARTITION BY vec_id // 50 ORDER BY vec_id)),
u AS (SELECT *, CASE WHEN t1 IS NULL THEN '' ELSE 'Recent history:' || chr(10) || t1 || chr(10) || 'Previous action_id: ' || a1 || chr(10) END || 'Current observation:' || chr(10) || text AS tail FROM a)
SELECT vec_id::BIGINT AS step, split, 'policy_action' AS task, md5('Allowed action_ids: [0, 1, 2, 3, 4, 5, 6]' || chr(10) || tail) AS user_md5, '{{"action_id": ' || pseudo_action_id || '}}' AS assistant, pseudo_direction, 'pseudo_visible_player_delta' AS label_source, false AS true_label FROM u
UNION ALL SELECT vec_id::BIGINT, split, 'next_frame', md5('Action taken: {{"action_id": ' || pseudo_action_id || '}}' || chr(10) || tail), 'frame ' || (vec_id + 1), pseudo_direction, 'pseudo_visible_player_delta', false FROM u
""")
def pseudo_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tasks from frames alone: 50 vectors are a trace, actions are labels of visible movement."""
    text = lambda x: F.concat(F.lit("frame "), x.cast("string"))
    steps = moves(spark, sf_dir).select(F.floor(F.col("vec_id") / 50).alias("gameid"), F.col("vec_id").alias("step"), text(F.col("vec_id")).alias("observation_text"), text(F.col("vec_id") + 1).alias("next_text"), *labels.PSEUDO)
    rows = build.pseudo_rows(splits.with_split(steps, "gameid", SEED), "frames", "context_1", range(7))
    last = lambda role: frames.last_content(F.col("messages"), role)
    return rows.select("step", "split", "task", F.md5(last("user").cast("binary")).alias("user_md5"), last("assistant").alias("assistant"), "metadata.pseudo_direction", "metadata.label_source", F.col("metadata.true_keypress_label_available").alias("true_label"))


# Limits of builds


LIMITS = {"train": 40, "validation": 10, "test": 10_000}


@registered(f"""
WITH {tables.STEPS_SQL}, n AS (SELECT split, task, count(*) AS n FROM t WHERE reason IS NULL GROUP BY 1, 2),
g AS (SELECT * FROM (VALUES ('train', 40), ('validation', 10), ('test', 10000)) l(split, row_limit), (VALUES ('policy_action'), ('next_frame')) k(task)),
x AS (SELECT split, task, row_limit, least(coalesce(n, 0), row_limit)::BIGINT AS accepted, greatest(0, coalesce(n, 0) - row_limit)::BIGINT AS skipped FROM g LEFT JOIN n USING (split, task))
SELECT split, task, row_limit, accepted, skipped, accepted >= row_limit AS reached, bool_and(accepted >= row_limit) OVER () AS all_reached FROM x
""")
def split_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row limits by split and task against what a build accepts; what is over a limit counts as skipped."""
    accepted = build.accepted_by_task(tables.conversation_steps(spark, sf_dir)).filter("reason IS NULL").groupBy("split", "task").agg(F.count("*").alias("n"))
    return build.limit_status(accepted, LIMITS)


@registered(f"{base.BUILT_SQL} SELECT split, task, count(*) AS n, count(DISTINCT gameid) AS games, sum(length(user_text))::BIGINT AS user_chars FROM b GROUP BY 1, 2")
def rows_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built rows written as JSON lines by split and task, and read again."""
    path = ledger.shared_folder(spark, "rows")
    writers.write_rows(base.built_rows(spark, sf_dir), path)
    rows = readers.read_rows(spark, path)
    user = F.length(frames.last_content(F.col("messages"), "user"))
    return rows.groupBy("split", "task").agg(F.count("*").alias("n"), F.countDistinct("gameid").alias("games"), F.sum(user).cast("long").alias("user_chars"))


@registered(f"""
{base.BUILT_SQL} SELECT task, count(*) AS n, count(DISTINCT gameid) AS games, min(gameid) AS first_game, max(gameid) AS last_game FROM b WHERE split = 'train' GROUP BY 1
""")
def existing_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written dataset opened again for evaluation: its manifest is checked, then the rows of one split are read."""
    path = ledger.shared_folder(spark, "dataset")
    build.write_dataset(base.built_rows(spark, sf_dir), path, dataset_name="talk", mode="context_2", env_id="talk-v0", label_source="role", actions=[(0, "user"), (1, "assistant"), (2, "tool")])
    rows = readers.eval_rows(spark, path, split="train", tasks=build.TASKS, mode="context_2", env_id="talk-v0", actions=[(0, "user"), (1, "assistant"), (2, "tool")])
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("gameid").alias("games"), F.min("gameid").alias("first_game"), F.max("gameid").alias("last_game"))


@registered(f"""
{base.BUILT_SQL}, r AS (SELECT count(*) FILTER (reason IS NOT NULL) AS n FROM t) SELECT 'talk' AS dataset_name, 'context_2' AS mode, 'talk-v0' AS env_id, count(*) AS accepted_rows, count(*) AS row_count, count(DISTINCT gameid) AS game_count, max(r.n)::BIGINT AS rejected_rows FROM b, r
""")
def dataset_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset written whole, with the report of what was rejected, and summed up from its files."""
    path = ledger.shared_folder(spark, "dataset")
    rejected = build.accepted_by_task(tables.conversation_steps(spark, sf_dir)).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("count"))
    build.write_dataset(base.built_rows(spark, sf_dir), path, dataset_name="talk", mode="context_2", env_id="talk-v0", label_source="role", actions=[(0, "user")], rejections=rejected)
    return readers.dataset_summary(spark, path)


@registered(f"""
{base.BUILT_SQL}, oo AS (SELECT gameid * 1000000 + step * 2 + (task = 'next_frame')::INTEGER AS ordinal, user_text FROM b)
SELECT ordinal, md5(substr(user_text, position('Current observation:' || chr(10) IN user_text) + 21)) AS frame_md5 FROM oo ORDER BY ordinal LIMIT 15
""")
def first_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 rows' current frames: the limit is the feature."""
    rows = base.built_rows(spark, sf_dir).withColumn("ordinal", F.col("gameid") * 1000000 + F.col("step") * 2 + (F.col("task") == "next_frame").cast("int"))
    return readers.initial_frames(rows, 15).select("ordinal", F.md5(F.col("frame").cast("binary")).alias("frame_md5"))


@registered(f"""
{base.BUILT_SQL}, oo AS (SELECT gameid * 1000000 + step AS ordinal, assistant_text FROM b WHERE task = 'next_frame') SELECT ordinal, md5(assistant_text) AS frame_md5 FROM oo ORDER BY ordinal LIMIT 15
""")
def first_true_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 true next frames: the limit is the feature."""
    rows = base.built_rows(spark, sf_dir).withColumn("ordinal", F.col("gameid") * 1000000 + F.col("step"))
    return readers.first_frames(rows, 15).select("ordinal", F.md5(F.col("frame").cast("binary")).alias("frame_md5"))


# Training rows


@registered(f"{base.BUILT_SQL} SELECT task, count(*) AS n, count(DISTINCT gameid) AS games FROM (SELECT * FROM b WHERE task = 'policy_action' OR {bucket_sql(SEED, 'gameid')} < 0.25::DOUBLE) GROUP BY 1")
def mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policy rows and a quarter of the traces' frame rows."""
    rows = base.built_rows(spark, sf_dir)
    mixed = training.mixed_curriculum(rows.filter("task = 'policy_action'"), rows.filter("task = 'next_frame'"), key="gameid", ratio=0.25, seed=SEED, keep=("gameid",))
    return mixed.groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("gameid").alias("games"))


@registered(f"""
{base.BUILT_SQL}, k AS (SELECT *, gameid * 100000 + step AS id FROM b), f AS (SELECT *, row_number() OVER (ORDER BY {bucket_sql(SEED, 'id')}, id) AS r, count(*) OVER () AS total FROM k WHERE task = 'next_frame')
SELECT 'dynamics_warmup' AS phase, task, count(*) AS n, sum(id)::BIGINT AS ids FROM f GROUP BY 2
UNION ALL SELECT 'mixed', task, count(*), sum(id)::BIGINT FROM f WHERE r <= floor(total * 0.3::DOUBLE) GROUP BY 2
UNION ALL SELECT 'mixed', task, count(*), sum(id)::BIGINT FROM k WHERE task = 'policy_action' GROUP BY 2
UNION ALL SELECT 'policy_calibration', task, count(*), sum(id)::BIGINT FROM k WHERE task = 'policy_action' GROUP BY 2
""")
def training_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.built_rows(spark, sf_dir).withColumn("id", F.col("gameid") * 100000 + F.col("step"))
    out = None
    for name, phase in training.phases(rows, "multitask", key="id", ratio=0.3, seed=SEED).items():
        counted = phase.groupBy("task").agg(F.count("*").alias("n"), F.sum("id").cast("long").alias("ids")).select(F.lit(name).alias("phase"), "task", "n", "ids")
        out = counted if out is None else out.union(counted)
    return out


@registered(f"SELECT doc_id FROM documents ORDER BY {bucket_sql(SEED, 'doc_id')}, doc_id LIMIT 37")
def exact_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 37: its size is the feature."""
    return splits.exact_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED, 37)


@registered("""
WITH w AS (SELECT turn % 2 AS even, role, len(string_split(coalesce(text, ''), ' ')) AS answer, turn % 40 + 1 AS prompt FROM conversations),
m AS (SELECT CASE WHEN even = 0 THEN 'policy_action' ELSE 'next_frame' END AS task, prompt, answer, least(prompt + answer, 120) AS kept FROM w)
SELECT coalesce(task, 'all') AS task, count(*) AS row_count, sum(kept)::BIGINT AS input_token_count, sum(prompt)::BIGINT AS prompt_token_count, sum(prompt)::BIGINT AS masked_prompt_token_count, sum(answer)::BIGINT AS assistant_token_count,
       sum(kept - prompt)::BIGINT AS supervised_assistant_token_count, sum(answer - kept + prompt)::BIGINT AS assistant_tokens_truncated, sum(prompt + answer - kept)::BIGINT AS truncated_token_count,
       count(*) FILTER (answer > kept - prompt) AS rows_with_truncated_assistant, round(sum(kept - prompt)::DOUBLE / sum(kept), 6) AS supervised_token_fraction
FROM m GROUP BY ROLLUP (task)
""")
def mask_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers to prompts of known length, cut at 120 words, tokenised by word."""
    prompt = F.array_join(F.array_repeat(F.lit("p"), (F.col("turn") % 40 + 1).cast("int")), " ")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = table(spark, sf_dir, "conversations").select(
        F.when(F.col("turn") % 2 == 0, "policy_action").otherwise("next_frame").alias("task"), F.array(message("user", prompt), message("assistant", F.coalesce("text", F.lit("")))).alias("messages")
    )

    def words(talks, add_prompt):
        return [[len(w) for m in talk for w in m["content"].split(" ")] for talk in talks]

    return training.mask_report(training.masked(rows, words, 120)).withColumn("supervised_token_fraction", F.round("supervised_token_fraction", 6))


@registered("""
WITH s AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS n, lag(role) OVER w AS lr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN n IS NULL THEN NULL ELSE '- action_id=' || turn || ' reward=<unknown> total=<unknown> hp=' || (turn * 2) || ' depth=' || (turn % 4) || ' advanced=<unknown> message="say ' || (turn + 1) || '"' END AS feedback FROM s
""")
def outcome_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback of a turn from the observation after it: message, hit points and depth of that, all else unknown."""
    c = table(spark, sf_dir, "conversations").withColumn("after", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    codes = lambda text: F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.ascii(x))
    blstats = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.when(k == 10, F.col("turn") * 2).when(k == 12, F.col("turn") % 4).otherwise(0).cast("int"))
    observation = F.when(F.col("after").isNotNull(), F.struct(codes(F.concat(F.lit("say "), (F.col("turn") + 1).cast("string"))).alias("message"), blstats.alias("blstats")))
    made = history.outcome_feedback(F.col("turn"), observation)
    line = F.regexp_replace(history.feedback_text(F.array(made)), "^Recent action feedback:\n", "")
    return c.select("conv_id", "turn", F.when(made.isNotNull(), line).alias("feedback"))
