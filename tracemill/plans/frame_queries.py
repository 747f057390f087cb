"""Queries of batches, frames, planes and their metrics, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import frames
from ..operators import evaluation, metrics, planes, rollouts, transitions
from . import queries as base
from .registry import registered, split_sql
from .tables import SEED, table

# Batches


@registered("SELECT l_orderkey AS batch, 0 AS lane, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS place, l_partkey, l_linenumber FROM lineitem")
def flat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as flat batches of parallel arrays, taken apart again."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    batches = lines.select(F.col("l_orderkey").alias("batch"), F.col("x.l_partkey").alias("l_partkey"), F.col("x.l_linenumber").alias("l_linenumber"))
    return transitions.flatten_batches(batches, ["l_partkey", "l_linenumber"], nested=False)


@registered("""
WITH o AS (SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS lane FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT o_custkey AS batch, lane::INTEGER AS lane, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS place, l_orderkey, l_partkey FROM o JOIN lineitem ON l_orderkey = o_orderkey
""")
def sequence_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as one batch of lanes and steps, taken apart again."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    lanes = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "parts"))).alias("x"))
    keys = F.transform("x", lambda v: F.transform(v["parts"], lambda _: v["o_orderkey"]))
    batches = lanes.select(F.col("o_custkey").alias("batch"), keys.alias("l_orderkey"), F.transform("x", lambda v: v["parts"]).alias("l_partkey"))
    return transitions.flatten_batches(batches, ["l_orderkey", "l_partkey"], nested=True)


# Frames


def observation() -> Column:
    """A vector as an observation: 8 lines of codes (a quarter of them 0), a message of 6, three numbers, an inventory by id."""
    code = lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int")
    codes = F.transform("embedding", lambda x: F.when(code(x) % 4 == 0, 0).otherwise(code(x) % 50 + 40))
    return F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(codes, r * 8 + 1, 8)).alias("tty_chars"),
        F.slice(codes, 1, 6).alias("message"),
        F.when(F.col("vec_id") % 5 != 0, F.slice(codes, 10, 3)).alias("blstats"),
        F.when(F.col("vec_id") % 3 == 1, F.slice(codes, 1, 0)).when(F.col("vec_id") % 3 == 2, F.slice(codes, 20, 2)).alias("inventory"),
    )


FRAMES_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 100)::INTEGER) AS e FROM embeddings),
k AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN x % 4 = 0 THEN 0 ELSE x % 50 + 40 END) AS c FROM v),
g AS (SELECT vec_id, c, list_transform(range(0, 8), lambda r: rtrim(array_to_string(list_transform(c[r * 8 + 1 : r * 8 + 8], lambda x: CASE WHEN x = 0 THEN ' ' ELSE chr(x) END), ''))) AS lines,
      array_to_string(list_transform(list_filter(c[1:6], lambda x: x <> 0), lambda x: chr(x)), '') AS message FROM k),
t AS (SELECT vec_id, regexp_replace(array_to_string(lines, chr(10)), '\\s+$', '') AS map, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) AS compact, message,
      CASE WHEN vec_id % 5 <> 0 THEN '[' || array_to_string(c[10:12], ', ') || ']' ELSE '<missing>' END AS numbers, CASE vec_id % 3 WHEN 1 THEN '<empty>' WHEN 2 THEN '[' || array_to_string(c[20:21], ', ') || ']' ELSE '<missing>' END AS things FROM g),
r AS (SELECT vec_id, 'MAP:' || chr(10) || coalesce(nullif(map, ''), '<missing>') || chr(10) || tail AS text, 'MAP:' || chr(10) || coalesce(nullif(compact, ''), '<missing>') || chr(10) || tail AS compact_text
      FROM (SELECT *, 'MESSAGE:' || chr(10) || coalesce(nullif(message, ''), '<missing>') || chr(10) || 'BLSTATS:' || chr(10) || numbers || chr(10) || 'INVENTORY:' || chr(10) || things AS tail FROM t))
"""


@registered(f"{FRAMES_SQL} SELECT vec_id, md5(text) AS text_md5, md5(compact_text) AS compact_md5 FROM r")
def rendered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", observation().alias("o"))
    digest = lambda x: F.md5(x.cast("binary"))
    return rows.select("vec_id", digest(frames.frame_text(F.col("o"))).alias("text_md5"), digest(frames.frame_text(F.col("o"), compact=True)).alias("compact_md5"))


def predicted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as frames: the current one, the next as truth, the one after as prediction."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("current_frame", base.framed("text"))
    rows = rows.withColumns({"label": F.lead("current_frame", 1).over(w), "prediction": F.lead("current_frame", 2).over(w)})
    return rows.filter("prediction IS NOT NULL").select("conv_id", "turn", "role", "current_frame", "label", "prediction")


PREDICTED_FRAMES_SQL = """
WITH x AS (SELECT conv_id, turn, role, coalesce(text, '') AS c, lead(coalesce(text, ''), 1) OVER w AS t, lead(coalesce(text, ''), 2) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT * FROM x WHERE p IS NOT NULL)
"""
NORMAL_SQL = "lower(trim(regexp_replace(split_part({0}, chr(10), 1), '\\s+', ' ', 'g')))"
WHOLE_SQL = "('MAP:' || chr(10) || {0} || chr(10) || 'MESSAGE:' || chr(10) || split_part({0}, chr(10), 1) || chr(10) || 'BLSTATS:' || chr(10) || '[' || length({0}) || ', 1]' || chr(10) || 'INVENTORY:' || chr(10) || '<empty>')"


@registered(f"""
{PREDICTED_FRAMES_SQL}, g AS (SELECT *, {WHOLE_SQL.format('t')} AS tt, {WHOLE_SQL.format('p')} AS pp FROM f),
s AS (SELECT *, len(list_filter(range(1, least(length(tt), length(pp)) + 1), lambda k: substr(tt, k, 1) = substr(pp, k, 1))) AS same, greatest(length(tt), length(pp)) AS total FROM g)
SELECT count(*) AS row_count, round(count(*) FILTER (t = p)::DOUBLE / count(*), 6) AS exact_match_rate, round(sum(same)::DOUBLE / sum(total), 6) AS char_accuracy, round(count(*) FILTER (t = p)::DOUBLE / count(*), 6) AS map_line_exact_rate,
       round(count(*) FILTER (split_part(t, chr(10), 1) = split_part(p, chr(10), 1))::DOUBLE / count(*), 6) AS message_exact_rate,
       round(count(*) FILTER ({NORMAL_SQL.format('t')} = {NORMAL_SQL.format('p')})::DOUBLE / count(*), 6) AS message_normalized_exact_rate FROM s
""")
def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text metrics of predicted frames (all but the similarity of messages, which SQL can't express)."""
    out = metrics.frame_metrics(predicted_frames(spark, sf_dir)).drop("message_edit_similarity")
    return out.select(*[c if c == "row_count" else F.round(c, 6).alias(c) for c in out.columns])


@registered(f"""
{PREDICTED_FRAMES_SQL}, s AS (SELECT conv_id, turn, 'c' AS side, string_split(c, chr(10)) AS l FROM f UNION ALL SELECT conv_id, turn, 't', string_split(t, chr(10)) FROM f UNION ALL SELECT conv_id, turn, 'p', string_split(p, chr(10)) FROM f),
q AS (SELECT conv_id, turn, side, unnest(l) AS line, unnest(range(len(l))) AS r FROM s), k AS (SELECT conv_id, turn, side, r, unnest(range(1, length(line) + 1)) AS col, line FROM q WHERE line <> ''),
z AS (SELECT conv_id, turn, r, col, max(substr(line, col, 1)) FILTER (side = 'c') AS c, max(substr(line, col, 1)) FILTER (side = 't') AS t, max(substr(line, col, 1)) FILTER (side = 'p') AS p FROM k GROUP BY ALL),
m AS (SELECT count(*) FILTER (t IS DISTINCT FROM c) AS true_changed, count(*) FILTER (p IS DISTINCT FROM c) AS predicted_changed, count(*) FILTER (t IS DISTINCT FROM c AND p IS DISTINCT FROM c AND p IS NOT DISTINCT FROM t) AS correct,
      count(*) FILTER (t IS NOT DISTINCT FROM c) AS unchanged, count(*) FILTER (t IS NOT DISTINCT FROM c AND p IS NOT DISTINCT FROM c) AS copied FROM z),
a AS (SELECT conv_id, turn, side, count(*) AS n, max(r * 100000 + col) AS place FROM k WHERE substr(line, col, 1) = '@' GROUP BY ALL),
y AS (SELECT count(*) AS players FROM a t JOIN a p USING (conv_id, turn) WHERE t.side = 't' AND p.side = 'p' AND t.n = 1 AND p.n = 1 AND t.place = p.place),
b AS (SELECT count(*) AS n, (2 * count(*))::DOUBLE AS fields, (count(*) + count(*) FILTER (length(t) = length(p)))::DOUBLE AS exact, sum(abs(length(p) - length(t)))::DOUBLE AS error FROM f)
SELECT n AS row_count, round(players::DOUBLE / n, 6) AS player_coordinate_exact_rate, round(correct::DOUBLE / predicted_changed, 6) AS changed_map_cell_precision, round(correct::DOUBLE / true_changed, 6) AS changed_map_cell_recall,
       round(2 * (correct::DOUBLE / predicted_changed) * (correct::DOUBLE / true_changed) / (correct::DOUBLE / predicted_changed + correct::DOUBLE / true_changed), 6) AS changed_map_cell_f1, round(copied::DOUBLE / unchanged, 6) AS unchanged_map_cell_copy_rate,
       1.0::DOUBLE AS blstats_parse_valid_rate, round(exact / fields, 6) AS blstats_field_exact_rate, round(error / fields, 6) AS blstats_numeric_mae, 1.0::DOUBLE AS blstats_numeric_comparable_rate, 0.0::DOUBLE AS game_turn_delta_exact_rate FROM m, y, b
""")
def changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed map cells, the player's place and the numbers of predicted frames."""
    out = metrics.changed_state_metrics(predicted_frames(spark, sf_dir))
    return out.select(*[c if c == "row_count" else F.round(c, 6).alias(c) for c in out.columns])


@registered(f"""
{PREDICTED_FRAMES_SQL}, g AS (SELECT *, length(c) AS n, len(list_filter(string_split(c, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS map_lines, contains(c, '@') AS player FROM f)
SELECT role, count(*) AS n, count(*) AS parse_valid, 0::BIGINT AS shape_valid, sum(map_lines)::BIGINT AS map_lines, count(*) FILTER (player) AS players, (2 * count(*))::BIGINT AS numbers, count(*) FILTER (c = t) AS exact,
       count(*) FILTER (trim(c, chr(10)) = trim(t, chr(10))) AS map_exact, count(*) FILTER (split_part(c, chr(10), 1) = split_part(t, chr(10), 1)) AS message_exact, count(*) FILTER (length(c) = length(t)) AS blstats_exact FROM g GROUP BY 1
""")
def frame_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of frames by themselves and against the next one."""
    v = predicted_frames(spark, sf_dir).select("role", frames.frame_validation(F.col("current_frame"), F.col("label")).alias("v"))
    count = lambda c: F.count_if(F.col(f"v.{c}"))
    return v.groupBy("role").agg(
        F.count("*").alias("n"), count("rendered_frame_parse_valid").alias("parse_valid"), count("observation_shape_valid").alias("shape_valid"), F.sum("v.map_nonempty_line_count").alias("map_lines"), count("map_has_player_glyph").alias("players"),
        F.sum("v.blstats_length").alias("numbers"), count("ground_truth_exact_match").alias("exact"), count("map_exact_match").alias("map_exact"), count("message_exact_match").alias("message_exact"), count("blstats_exact_match").alias("blstats_exact"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all kinds by turn: raw frames, JSON with a frame, and JSON that is cut, of another shape or no JSON."""
    t, n = F.col("turn") % 7, F.col("turn").cast("string")
    text = (
        F.when(t == 0, F.concat(F.lit("  MAP:\nx"), n))
        .when(t == 1, F.concat(F.lit('{"next_frame": "frame '), n, F.lit('"}')))
        .when(t == 2, F.lit('{"next_frame": 5}'))
        .when(t == 3, F.concat(F.lit('{"next_frame": "cut '), n))
        .when(t == 4, F.lit('{"other": 1}'))
        .when(t == 5, F.lit("hello"))
        .otherwise(F.lit('{"next_frame": "a", "more": 1}'))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("response")).withColumn("parsed", frames.parsed_response(F.col("response")))


@registered("""
SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN 'MAP:' || chr(10) || 'x' || turn WHEN 1 THEN 'frame ' || turn END AS frame, CASE turn % 7 WHEN 2 THEN 'wrong_value_type' WHEN 3 THEN 'truncated_json' WHEN 4 THEN 'wrong_schema' WHEN 5 THEN 'invalid_json' WHEN 6 THEN 'wrong_schema' END AS failure FROM conversations
""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).select("conv_id", "turn", "parsed.frame", frames.parse_failure(F.col("response"), F.col("parsed.error")).alias("failure"))


@registered("""
SELECT count(*) AS row_count, round(count(*) FILTER (turn % 7 = 3)::DOUBLE / count(*), 6) AS truncated_json_rate, round(count(*) FILTER (turn % 7 = 5)::DOUBLE / count(*), 6) AS invalid_json_rate,
       round(count(*) FILTER (turn % 7 IN (4, 6))::DOUBLE / count(*), 6) AS wrong_schema_rate, round(count(*) FILTER (turn % 7 = 2)::DOUBLE / count(*), 6) AS wrong_value_type_rate FROM conversations
""")
def answer_failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses(spark, sf_dir).withColumn("failure", frames.parse_failure(F.col("response"), F.col("parsed.error")))
    out = metrics.failure_rates(rows, "failure")
    return out.select(*[c if c == "row_count" else F.round(c, 6).alias(c) for c in out.columns])


TILES = "abc.#|-@"


@registered("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: substr('abc.#|-@', (floor(abs(x::DOUBLE) * 100)::INTEGER) % 8 + 1, 1)) AS c FROM embeddings),
l AS (SELECT vec_id, unnest(range(0, 8)) AS r, c FROM v), m AS (SELECT vec_id, r, array_to_string(c[r * 8 + 1 : r * 8 + 8], '') AS line FROM l),
n AS (SELECT *, 8 - length(regexp_replace(line, '[.#|@-]', '', 'g')) AS tiles FROM m),
k AS (SELECT vec_id // 20 AS episode, r, line, unnest(range(1, 9)) AS col FROM n WHERE tiles > 0 AND CASE WHEN contains(line, '@') THEN true WHEN regexp_matches(line, '[|+<>-]') THEN tiles >= 2 ELSE tiles >= 3 AND tiles / 8.0 >= 0.5 END)
SELECT episode, count(DISTINCT (r, col, substr(line, col, 1))) AS visible_map_novelty_count FROM k WHERE contains('.#|-@', substr(line, col, 1)) GROUP BY 1
""")
def novel_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as maps of letters and tiles, 20 to an episode: distinct tiles seen."""
    code = lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int") % 8 + 1
    characters = F.transform("embedding", lambda x: F.substr(F.lit(TILES), code(x), F.lit(1)))
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.array_join(F.slice(characters, r * 8 + 1, 8), ""))
    frame = F.concat(F.lit("MAP:\n"), F.array_join(lines, "\n"), F.lit("\nMESSAGE:\nhi"))
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("episode"), frame.alias("terminal_frame"))
    return rollouts.novelty(rows, episode=["episode"])


@registered("""
WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS a FROM conversations),
p AS (SELECT x.conv_id, x.turn, x.text, (y.n - x.n)::INTEGER + 1 AS "offset", y.a AS action, sum(y.a) OVER (PARTITION BY x.conv_id, x.turn ORDER BY y.n) AS shift FROM s x JOIN s y ON x.conv_id = y.conv_id AND y.n BETWEEN x.n AND x.n + 3)
SELECT conv_id, turn, "offset", action, md5(CASE WHEN length(text) = 0 THEN '' ELSE substr(text, (shift % length(text))::BIGINT + 1) || left(text, (shift % length(text))::BIGINT) END) AS prediction_md5 FROM p
""")
def predicted_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn played on for up to four actions by a predictor that turns its text by as many characters as the action says."""
    return played(spark, sf_dir).select("conv_id", "turn", "offset", "action", F.md5(F.col("prediction").cast("binary")).alias("prediction_md5"))


def played(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(0, 3)
    action = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    starts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("frame"), F.collect_list(action).over(w).alias("actions"))

    def turned(texts, actions):
        return [t[a % len(t) :] + t[: a % len(t)] if t else t for t, a in zip(texts, actions, strict=True)]

    return metrics.predicted_rollouts(starts, turned, key=["conv_id", "turn"])


@registered("""
WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS a FROM conversations),
p AS (SELECT x.conv_id, x.n, x.text, (y.n - x.n)::INTEGER + 1 AS "offset", sum(y.a) OVER (PARTITION BY x.conv_id, x.turn ORDER BY y.n) AS shift FROM s x JOIN s y ON x.conv_id = y.conv_id AND y.n BETWEEN x.n AND x.n + 3),
q AS (SELECT p.*, CASE WHEN length(p.text) = 0 THEN '' ELSE substr(p.text, (shift % length(p.text))::BIGINT + 1) || left(p.text, (shift % length(p.text))::BIGINT) END AS prediction, z.text AS truth FROM p LEFT JOIN s z ON z.conv_id = p.conv_id AND z.n = p.n + p."offset"),
r AS (SELECT *, greatest(length(prediction), length(truth)) AS total, len(list_filter(range(1, least(length(prediction), length(truth)) + 1), lambda k: substr(prediction, k, 1) = substr(truth, k, 1))) AS same FROM q WHERE truth IS NOT NULL),
t AS (SELECT "offset", count(*) AS n FROM q GROUP BY 1)
SELECT "offset", any_value(t.n) AS n, count(*) AS with_truth, count(*) FILTER (prediction = truth) AS exact, round(avg(CASE WHEN total = 0 THEN 1.0 ELSE same::DOUBLE / total END), 6) AS char_accuracy FROM r JOIN t USING ("offset") GROUP BY 1
""")
def rollout_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames played by the predictor against the turns that followed, as far as there are any."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("after", F.collect_list(F.coalesce("text", F.lit(""))).over(w.rowsBetween(1, 4)))
    truths = c.select("conv_id", "turn", F.posexplode("after").alias("offset", "truth")).withColumn("offset", F.col("offset") + 1)
    told = metrics.with_truth(played(spark, sf_dir), truths, key=["conv_id", "turn"])
    return told.groupBy("offset").agg(F.count("*").alias("n"), F.count("truth").alias("with_truth"), F.count_if("exact").alias("exact"), F.round(F.avg("char_accuracy"), 6).alias("char_accuracy"))


# Planes


def signed_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of vectors as character planes, tenths as colour planes: a row, the next as truth, the one after as prediction."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("chars"), F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 10).cast("int") % 2).alias("colors"))
    shifted = lambda k, n: rows.select((F.col("vec_id") - k).alias("vec_id"), F.col("chars").alias(f"{n}_chars"), F.col("colors").alias(f"{n}_colors"))
    return shifted(0, "current").join(shifted(1, "next"), "vec_id").join(shifted(2, "pred"), "vec_id")


PLANES_SQL = """
WITH v AS (SELECT vec_id, embedding AS e, list_transform(embedding, lambda x: (x > 0)::INTEGER) AS s, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 10)::INTEGER % 2) AS k FROM embeddings),
j AS (SELECT a.vec_id, unnest(a.s) AS c, unnest(a.k) AS ck, unnest(b.s) AS t, unnest(b.k) AS tk, unnest(d.s) AS p, unnest(d.k) AS pk, unnest(range(len(a.s))) AS place FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v d ON d.vec_id = a.vec_id + 2)
"""


@registered(f"""
{PLANES_SQL}, x AS (SELECT vec_id, count(*) FILTER (t <> c OR tk <> ck) AS tc, count(*) FILTER (p <> c OR pk <> ck) AS pc, count(*) FILTER ((t <> c OR tk <> ck) AND (p <> c OR pk <> ck)) AS tp FROM j GROUP BY 1),
r AS (SELECT vec_id, CASE WHEN pc = 0 THEN 0 ELSE tp::DOUBLE / pc END AS a, CASE WHEN tc = 0 THEN 0 ELSE tp::DOUBLE / tc END AS b FROM x)
SELECT vec_id, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 6) AS changed_f1 FROM r
""")
def example_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of changed cells, example by example."""
    return signed_planes(spark, sf_dir).select("vec_id", F.round(planes.changed_f1(), 6).alias("changed_f1"))


@registered(f"{PLANES_SQL} SELECT vec_id, string_agg(CASE WHEN c = t THEN 0 ELSE t + 1 END, '' ORDER BY place) AS char_delta, string_agg(CASE WHEN ck = tk THEN 0 ELSE tk + 1 END, '' ORDER BY place) AS color_delta, true AS restores FROM j GROUP BY 1")
def delta_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model of changes is taught, and that applying it gives the next planes back."""
    rows = signed_planes(spark, sf_dir).select("vec_id", "current_chars", "next_chars", "current_colors", "next_colors", *planes.delta_targets())
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    restores = (metrics.apply_terminal_delta(F.col("current_chars"), F.col("char_delta")) == F.col("next_chars")) & (metrics.apply_terminal_delta(F.col("current_colors"), F.col("color_delta")) == F.col("next_colors"))
    return rows.select("vec_id", text("char_delta").alias("char_delta"), text("color_delta").alias("color_delta"), restores.alias("restores"))


@registered("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)::INTEGER) AS e FROM embeddings)
SELECT CASE WHEN vec_id % 7 = 0 THEN 'missing_terminal_plane' WHEN vec_id % 11 = 0 THEN 'terminal_shape_invalid' WHEN list_min(e) < -20 OR list_max(e) > 255 THEN 'terminal_value_out_of_range' ELSE 'accepted' END AS reason, count(*) AS n FROM v GROUP BY 1
""")
def plane_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which terminal planes can't be taken, and why."""
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int") + 20)
    lines = F.transform(F.sequence(F.lit(0), F.when(F.col("vec_id") % 11 == 0, 6).otherwise(7)), lambda r: F.slice(F.transform(values, lambda x: F.when(x > 275, 256).when(x < 0, -1).otherwise(F.least(x, F.lit(255)))), r * 8 + 1, 8))
    rows = table(spark, sf_dir, "embeddings").select(F.struct(F.when(F.col("vec_id") % 7 != 0, lines).alias("tty_chars")).alias("o"))
    return rows.groupBy(F.coalesce(transitions.terminal_reason(F.col("o"), 8, 8), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@registered(f"""
WITH g AS (SELECT DISTINCT vec_id // 20 AS gameid FROM embeddings), s AS (SELECT gameid, {split_sql(SEED, 'gameid')} AS split FROM g),
r AS (SELECT vec_id, s.gameid, split, row_number() OVER (PARTITION BY split ORDER BY vec_id) AS n FROM embeddings JOIN s ON s.gameid = vec_id // 20),
k AS (SELECT * FROM r WHERE n <= CASE split WHEN 'train' THEN 60 ELSE 15 END)
SELECT split, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS split_code, count(*) AS n, count(DISTINCT gameid) AS games, min(vec_id)::BIGINT AS first_row, max(vec_id)::BIGINT AS last_row, (count(*) * 64)::BIGINT AS plane_bytes FROM k GROUP BY 1
""")
def transition_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A world-model table: planes as bytes, capped by split (the caps are the feature), checked as it is written and read again."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("chars"), F.floor(F.col("vec_id") / 20).alias("gameid"))
    steps = vectors.select("gameid", F.col("vec_id").alias("step"), F.lit(0).alias("action_id"), *[F.col("chars").alias(f"{side}_{kind}") for side in ("current", "next") for kind in ("chars", "colors")])
    read = planes.round_trip(planes.collected(steps, SEED, {"train": 60, "validation": 15, "test": 15}, order=["step"]))
    return read.groupBy("split", "split_code").agg(
        F.count("*").alias("n"), F.countDistinct("gameid").alias("games"), F.min("step").alias("first_row"), F.max("step").alias("last_row"), F.sum(F.octet_length("current_chars")).cast("long").alias("plane_bytes")
    )


@registered("""
WITH s AS (SELECT DISTINCT vec_id // 20 AS gameid, CASE WHEN vec_id % 40 = 7 THEN 'validation' ELSE 'train' END AS split FROM embeddings), n AS (SELECT *, count(*) OVER (PARTITION BY gameid) AS c FROM s)
SELECT split, gameid::BIGINT AS gameid, 'game_in_several_splits' AS failure FROM n WHERE c > 1 UNION ALL SELECT 'test', NULL, 'split_without_rows'
""")
def plane_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of a table that lacks one and has games in two."""
    split = F.when(F.col("vec_id") % 40 == 7, "validation").otherwise("train")
    return planes.split_failures(table(spark, sf_dir, "embeddings").select(split.alias("split"), F.floor(F.col("vec_id") / 20).alias("gameid")))


# Candidates and rankings


@registered("""
WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT event_type, row_number() OVER (ORDER BY n DESC, event_type) AS k FROM c),
p AS (SELECT e.event_id, r.event_type AS candidate, r.event_type = e.event_type AS is_true, row_number() OVER (PARTITION BY e.event_id ORDER BY r.event_type <> e.event_type, k) AS place FROM events e, r WHERE e.event_id % 2 = 1 AND e.event_type IN (SELECT event_type FROM c))
SELECT candidate, is_true, count(*) AS n FROM p WHERE place <= 3 GROUP BY 1, 2
""")
def ranking_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates per held-out row: its true action and the most frequent others of the training rows."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("action"))
    found = planes.candidates(events.filter("event_id % 2 = 1"), events.filter("event_id % 2 = 0"), row="event_id", action="action", count=3)
    return found.groupBy("candidate", "is_true").agg(F.count("*").alias("n"))


@registered("""
WITH s AS (SELECT user_id, event_type AS action, count(*)::DOUBLE AS score FROM events GROUP BY 1, 2), t AS (SELECT user_id, arg_max(event_type, event_id) AS truth FROM events GROUP BY 1),
r AS (SELECT t.user_id, max(score) FILTER (action = truth) AS ts, list(score) AS a FROM s JOIN t USING (user_id) GROUP BY 1), q AS (SELECT len(list_filter(a, lambda x: x >= ts)) AS rank FROM r)
SELECT count(*) AS row_count, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg((rank = 1)::INTEGER), 6) AS top1_rate FROM q
""")
def ranked_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a user's actions as scores, the last action as the true one."""
    out = metrics.action_ranking(scored_actions(spark, sf_dir), row="user_id", action="action", true_action="truth", score="score")
    return out.withColumns({"mrr": F.round("mrr", 6), "top1_rate": F.round("top1_rate", 6)})


def scored_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    scores = events.groupBy("user_id", F.col("event_type").alias("action")).agg(F.count("*").cast("double").alias("score"))
    return scores.join(events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("truth")), "user_id")


@registered("""
WITH s AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS action, count(*) AS score FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT user_id, action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, action) AS k FROM s) WHERE k = 1
""")
def best_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid action that a user has most often, ties to the smallest."""
    from .tables import ACTIONS

    actions = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    scores = scored_actions(spark, sf_dir).select("user_id", F.element_at(actions, F.col("action")).alias("action"), "score")
    return metrics.best_action(scores, row="user_id", action="action", score="score", valid=[0, 1, 2, 3])


@registered("SELECT count(*) AS row_count, sum(l_quantity::INTEGER)::BIGINT AS tokens, round(sum((l_extendedprice * 100)::BIGINT)::DOUBLE / sum(l_quantity::INTEGER) / 100000, 6) AS mean_nll, round(sum(l_linenumber)::DOUBLE / sum(l_quantity::INTEGER), 6) AS token_accuracy FROM lineitem WHERE l_quantity::INTEGER > 0")
def teacher_forced_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows with summed losses, token counts and correct tokens."""
    rows = table(spark, sf_dir, "lineitem").select((F.round(F.col("l_extendedprice") * 100).cast("long").cast("double")).alias("nll_sum"), F.col("l_quantity").cast("int").alias("token_count"), F.col("l_linenumber").alias("correct_tokens"))
    out = metrics.teacher_forced(rows)
    return out.select("row_count", "tokens", F.round(F.col("mean_nll") / 100000, 6).alias("mean_nll"), F.round("token_accuracy", 6).alias("token_accuracy"))


@registered("SELECT count(*) AS count, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(value) AS min, arg_max(value, event_id) < arg_min(value, event_id) AS decreased FROM events WHERE value IS NOT NULL")
def loss_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.loss_summary(table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss")))


@registered("SELECT coalesce(nullif(lang, ''), 'unknown') AS role, count(*) AS n, count(*) FILTER (n_chars > 1000) AS exact, round(count(*) FILTER (n_chars > 1000)::DOUBLE / count(*), 6) AS rate FROM documents GROUP BY 1")
def role_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_role(table(spark, sf_dir, "documents"), "lang", F.col("n_chars") > 1000)


@registered()
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean difference of the first two components of all vectors (tested against brute force)."""
    pairs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.get("embedding", F.lit(0)).cast("double").alias("baseline"), F.get("embedding", F.lit(1)).cast("double").alias("candidate"))
    return metrics.bootstrap_interval(pairs, seed=SEED, samples=1000)


@registered(f"""
{PLANES_SQL}, x AS (
  SELECT vec_id // 10 AS game, (vec_id % 3 + 1)::INTEGER AS horizon, count(*) AS cells, count(*) FILTER (p = t) AS char_correct, (count(*) FILTER (p <> t) = 0)::BIGINT AS exact_frames, count(*) FILTER (t <> c) AS true_changed, count(*) FILTER (p <> c) AS predicted_changed,
         count(*) FILTER (t <> c AND p <> c) AS true_positive_changed, count(*) FILTER (t <> c OR tk <> ck) AS tc, count(*) FILTER (p <> c OR pk <> ck) AS pc, count(*) FILTER ((t <> c OR tk <> ck) AND (p <> c OR pk <> ck)) AS tp
  FROM j GROUP BY vec_id
), f AS (
  SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp::DOUBLE / pc) * (tp::DOUBLE / tc) / (tp::DOUBLE / pc + tp::DOUBLE / tc) END AS own FROM x
), g AS (
  SELECT CASE WHEN grouping(game) = 0 THEN 'game' WHEN grouping(horizon) = 0 THEN 'horizon' ELSE 'all' END AS grain, game, horizon, count(*) AS examples, sum(cells)::BIGINT AS cells, sum(char_correct)::BIGINT AS char_correct, sum(exact_frames)::BIGINT AS exact_frames,
         sum(true_changed)::DOUBLE AS t, sum(predicted_changed)::DOUBLE AS p, sum(true_positive_changed)::DOUBLE AS b, round(avg(own), 9) AS mean_example_f1
  FROM f GROUP BY GROUPING SETS ((), (game), (horizon))
)
SELECT grain, coalesce(game, -1)::BIGINT AS game, coalesce(horizon, -1)::INTEGER AS horizon, examples, cells, char_correct, exact_frames, round(char_correct::DOUBLE / cells, 9) AS char_accuracy, round(CASE WHEN b = 0 THEN 0 ELSE 2 * (b / p) * (b / t) / (b / p + b / t) END, 9) AS changed_cell_f1, mean_example_f1 FROM g
""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as planes, ten to a game and three horizons: figures of all, of each game and of each horizon from one expansion."""
    rows = signed_planes(spark, sf_dir).withColumns({"game": F.floor(F.col("vec_id") / 10).cast("long"), "horizon": (F.col("vec_id") % 3 + 1).cast("int")})
    found = evaluation.evaluated(rows, [[], ["game"], ["horizon"]], map_cells=48, digits=9)
    return found.select("grain", F.coalesce("game", F.lit(-1)).alias("game"), F.coalesce("horizon", F.lit(-1)).alias("horizon"), "examples", "cells", "char_correct", "exact_frames", "char_accuracy", "changed_cell_f1", "mean_example_f1")
