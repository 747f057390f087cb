"""Operators on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import audit, build, compare, history, labels, metrics, rollouts, splits, transitions
from tracemill.sources import readers, schemas, writers


def test_sequence_batches(spark):
    batches = spark.createDataFrame([(0, [[11, 11, 11], [22, 22, 23]], [[5, 6, 7], [8, 9, 9]], [[False, False, False], [False, False, False]])], "batch int, gameids array<array<int>>, stamps array<array<int>>, done array<array<boolean>>")
    rows = transitions.flatten_batches(batches, ["gameids", "stamps", "done"], nested=True)
    rows = transitions.pair_next(rows, "place", lane=["batch", "lane"], order=["place"], game="gameids", done="done", alias="following")
    rows = transitions.sequence_ids(rows, lane=["batch", "lane"], order=["place"], game="gameids", stamp="stamps")
    got = {(r.lane, r.place): (r.following, r.sequence_id) for r in rows.collect()}
    assert got == {(0, 0): (1, "11:5"), (0, 1): (2, "11:5"), (0, 2): (None, "11:5"), (1, 0): (1, "22:8"), (1, 1): (None, "22:8"), (1, 2): (None, "23:8")}


def test_flat_batches(spark):
    batches = spark.createDataFrame([(0, [1, 1, 2], [107, 106, 999])], "batch int, gameids array<int>, keypresses array<int>")
    rows = transitions.pair_next(transitions.flatten_batches(batches, ["gameids", "keypresses"], nested=False), "keypresses", lane=["batch"], order=["place"], game="gameids")
    assert [(r.gameids, r.next_value) for r in rows.orderBy("place").collect()] == [(1, 106), (1, None), (2, None)]


def test_islands_split_at_repeats(spark):
    rows = spark.createDataFrame([(1, s) for s in (0, 1, 3, 3)], "k int, s int")
    assert [r["count"] for r in transitions.islands(rows, key=["k"], step="s").groupBy("island").count().orderBy("island").collect()] == [2, 1, 1]


def test_rollout_starts(spark):
    rows = spark.createDataFrame(list(zip([1, 1, 1, 2, 2, 2, 2], [0, 1, 3, 0, 1, 2, 3])), "q int, s int")
    assert sorted((r.q, r.s) for r in transitions.rollout_starts(rows, sequence="q", step="s", horizon=3).collect()) == [(2, 0), (2, 1)]


def test_caps_and_planes(spark):
    rows = spark.createDataFrame([("train", k) for k in range(5)] + [("test", k) for k in range(5)], "split string, o int")
    assert {(r.split, r.o) for r in transitions.capped_by_split(rows, {"train": 2, "test": 1}, order=["o"]).collect()} == {("train", 0), ("train", 1), ("test", 0)}
    r = spark.range(1).select(
        metrics.terminal_delta(F.array(F.lit(32), F.lit(10)), F.array(F.lit(32), F.lit(65))).alias("d"), metrics.apply_terminal_delta(F.array(F.lit(32), F.lit(10)), F.array(F.lit(0), F.lit(66))).alias("a")
    ).head()
    assert (r.d, r.a) == ([0, 66], [32, 65])


def test_history_modes(spark):
    rows = spark.createDataFrame([(1, k, "x" * k, k) for k in range(20)], "g int, s int, observation_text string, action_id int")
    rows = history.with_history(rows, game="g", order=["s"], items=["observation_text", "action_id"])
    size = lambda mode, budget=1: F.size(history.for_mode(F.col("history"), mode, budget)).alias(mode)
    last = rows.select("s", size("single_frame"), size("context_3"), size("context_0"), size("growing_context", 13)).orderBy(F.desc("s")).head()
    # context_0 shows all 16 items; growing: 18 + 2 + 17 + 2 fit in 52 characters, one more does not
    assert last[1:] == (0, 3, 16, 2)
    with pytest.raises(ValueError):
        history.for_mode(F.col("history"), "other", 1)


FEEDBACK = "array<struct<action_id: int, reward: string, cumulative_reward: string, hp: int, depth: int, game_time_advanced: string, message: string>>"


def test_prompts(spark):
    items = F.array(F.struct(F.lit("old").alias("observation_text"), F.lit(4).alias("action_id")))
    r = spark.range(1).select(history.prompt(F.lit("H"), F.lit("now"), items).alias("a"), history.with_feedback(F.lit("now"), F.array().cast(FEEDBACK)).alias("b")).head()
    assert r.a == "H\nRecent history:\nold\nPrevious action_id: 4\nCurrent observation:\nnow" and r.b == "now"


def test_global_cap_reads_to_the_end_if_short(spark):
    rows = spark.createDataFrame([("policy_action", None, 1), ("next_frame", None, 2), ("policy_action", None, 3), ("next_frame", None, 4)], "task string, reason string, ordinal int")
    assert build.global_cap(rows, 1).count() == 1 and build.global_cap(rows, 2).count() == 3 and build.global_cap(rows, 9).count() == 4


def test_rows_of_both_tasks(spark):
    rows = spark.createDataFrame([("train", 7, 3, 1, "now", "then" * 2000)], "split string, gameid int, step int, action_id int, observation_text string, next_text string")
    empty = F.slice(F.array(F.struct(F.lit("").alias("observation_text"), F.lit(0).alias("action_id"))), 1, 0)
    p, f = build.policy_row(rows, "d", "single_frame", [0, 1], empty).head(), build.frame_row(rows, "d", "single_frame", empty).head()
    assert (p.episode_id, p.messages[1].content, p.messages[2].content) == ("d:7", "Allowed action_ids: [0, 1]\nCurrent observation:\nnow", '{"action_id": 1}')
    assert f.messages[1].content.startswith('Action taken: {"action_id": 1}\n') and len(f.messages[2].content) == 4096


def test_merging(spark):
    shard = spark.createDataFrame([("a", 1), ("b", 2)], "reason string, count long")
    assert {tuple(r) for r in build.merge_reasons([shard, shard]).collect()} == {("a", 2), ("b", 4)}
    counts = spark.createDataFrame([("train", "next_frame", 3)], "split string, task string, n long")
    assert build.zero_filled(counts).agg(F.sum("n"), F.count("*")).head()[:] == (3, 6)
    manifests = spark.createDataFrame([("d", "m", ["x"], "t", "e"), ("d", "m", ["x"], "t", "f")], "dataset_name string, mode string, tasks array<string>, label_source string, env_id string")
    assert not build.mergeable(manifests).head()[0] and build.mergeable(manifests.limit(1)).head()[0]


def test_movement_labels(spark):
    actions = spark.createDataFrame([(0, 0, "CompassDirection.N", "k"), (1, 1, "CompassDirection.E", "l")], "ordinal int, action_id int, nle_action_name string, key_label string")
    grid = lambda r, c: [[64 if (i, j) == (r, c) else 46 for j in range(3)] for i in range(3)]
    rows = spark.createDataFrame([(0, grid(1, 1), grid(0, 1)), (1, grid(1, 1), grid(1, 2)), (2, grid(1, 1), grid(2, 1)), (3, grid(1, 1), grid(1, 1)), (4, [[64, 64]], grid(0, 0)), (5, grid(1, 1), None)], "o int, a array<array<int>>, b array<array<int>>")
    got = labels.with_movement_labels(rows, actions, "a", "b").orderBy("o").collect()
    assert [(r.pseudo_direction, r.pseudo_action_id) for r in got] == [("N", 0), ("E", 1), (None, None), (None, None), (None, None), (None, None)]


def sft_row(split="train", task="policy_action", game=1, step=0, action=0, key=107, assistant=None, user=None, **more):
    frame = "MAP:\n@.\nMESSAGE:\nReady\nBLSTATS:\n[0]\nINVENTORY:\n<empty>"
    user = user or ("Allowed action_ids: [0, 1]\nCurrent observation:\n" + frame if task == "policy_action" else f'Action taken: {{"action_id": {action}}}\nCurrent observation:\n{frame}')
    assistant = assistant or (f'{{"action_id": {action}}}' if task == "policy_action" else frame.replace("@.", ".@"))
    name = "target_action_id" if task == "policy_action" else "conditioning_action_id"
    row = {"split": split, "task": task, "gameid": game, "episode_id": f"d:{game}", "step": step, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": user}, {"role": "assistant", "content": assistant}]}
    return json.dumps(row | {"metadata": {name: action, "raw_key_code": key, "valid_action_ids": [0, 1], "role": "Sam"}} | more)


def audited(spark, tmp_path, lines, split="train", task="policy_action"):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(lines) + "\n\n")
    rows = readers.read_rows_for_audit(spark, str(path)).withColumns({"split_dir": F.lit(split), "task_dir": F.lit(task), "ordinal": F.monotonically_increasing_id()})
    keys = build.key_map(spark.createDataFrame([(107, 0), (106, 1), (104, 0), (104, 1)], "raw_key_code int, action_id int"))
    games = spark.createDataFrame([("train", 1), ("test", 3)], "split string, gameid long")
    return audit.failures(rows, valid_ids=[0, 1], keys=keys, split_games=games)


def test_audit_names_failures(spark, tmp_path):
    lines = [
        sft_row(), sft_row(), sft_row(step=1, game=3), sft_row(step=2, action=1), sft_row(step=3, key=999), sft_row(step=4, key=104), sft_row(step=5, assistant='{"action_id": true}'),
        sft_row(step=6, split="test"), sft_row(step=7, messages=[]), "{broken", sft_row(step=8, action=5, key=None), sft_row(step=9, assistant='{"action_id": 1}'),
    ]
    got = [r.failures for r in audited(spark, tmp_path, lines).orderBy("ordinal").collect()]
    assert got == [
        [], ["duplicate_task_row_identity"], ["row_game_missing_from_split_manifest"], ["policy_raw_key_target_mismatch"], ["row_raw_key_unmapped"], ["row_raw_key_ambiguous"], ["policy_action_json_invalid"],
        ["row_split_mismatch"], ["row_messages_invalid"], ["malformed_json_row"], ["row_raw_key_code_missing", "policy_target_out_of_space"], ["policy_assistant_target_mismatch"],
    ]
    report = {r.reason: (r["count"], len(r.examples)) for r in audit.failure_report(audited(spark, tmp_path, lines)).collect()}
    assert report["malformed_json_row"] == (1, 1)


def test_audit_of_frames(spark, tmp_path):
    lines = [sft_row(task="next_frame"), sft_row(task="next_frame", step=1, user="other"), sft_row(task="next_frame", step=2, assistant="MAP:\n@")]
    rows = audited(spark, tmp_path, lines, task="next_frame").orderBy("ordinal").collect()
    assert [r.failures for r in rows] == [[], ["next_frame_prompt_action_mismatch"], ["next_frame_target_shape_invalid"]] and [r.changed for r in rows] == [True, None, True]


def test_pairing_is_null_safe(spark):
    fields = "episode_id string, step int, sequence_id string, sequence_step int, label int, ordinal int"
    a = spark.createDataFrame([("e", 0, None, None, 1, 0), ("e", 1, None, None, 1, 1)], fields)
    b = spark.createDataFrame([("e", 0, None, None, 2, 0), ("f", 0, None, None, 1, 1)], fields)
    assert audit.paired(a, b).head()[:] == (1, 1, 1, 1)


def test_policy_metrics_ties_and_missing(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (None, 1), (5, 1)], "prediction int, label int")
    r = metrics.policy_metrics(rows, F.col("prediction").isin(0, 1)).head()
    assert (r.row_count, r.exact, r.parse_valid_rate, r.action_space_valid_rate, r.target_dominant, r.predicted_dominant) == (4, 1, 0.75, 0.5, 0, 0)
    assert (r.macro_action_accuracy, r.non_modal_exact_match_rate, r.dominant_action_collapse) == (0.25, 0.0, 0)
    empty = metrics.policy_metrics(rows.limit(0), F.lit(True)).head()
    assert (empty.row_count, empty.exact_match_rate, empty.target_dominant) == (0, 0.0, None)


def frames_of(spark, *rows):
    text = lambda m, s, b: f"MAP:\n{m}\nMESSAGE:\n{s}\nBLSTATS:\n{b}\nINVENTORY:\n<empty>"
    return spark.createDataFrame([tuple(text(*x) for x in r) for r in rows], "current_frame string, prediction string, label string")


def test_copying_the_current_frame_scores_no_change(spark):
    rows = frames_of(spark, (("@.", "a", "[1, 2]"), ("@.", "a", "[1, 2]"), (".@", "b", "[1, 3]")))
    r = metrics.changed_state_metrics(rows).head()
    assert (r.changed_map_cell_f1, r.changed_map_cell_recall, r.unchanged_map_cell_copy_rate, r.player_coordinate_exact_rate) == (0.0, 0.0, 0.0, 0.0)
    assert (r.blstats_field_exact_rate, r.blstats_numeric_mae, r.blstats_parse_valid_rate) == (0.5, 0.5, 1.0)
    exact = metrics.changed_state_metrics(rows.withColumn("prediction", F.col("label"))).head()
    assert (exact.changed_map_cell_f1, exact.player_coordinate_exact_rate) == (1.0, 1.0)
    f = metrics.frame_metrics(rows).head()
    assert (f.exact_match_rate, f.map_line_exact_rate, f.message_exact_rate) == (0.0, 0.0, 0.0) and 0 < f.char_accuracy < 1


def test_losses_ranking_bootstrap(spark):
    rows = spark.createDataFrame([(2.0, 4, 1), (9.0, 0, 0)], "nll_sum double, token_count int, correct_tokens int")
    assert metrics.teacher_forced(rows).head()[:3] == (1, 4, 0.5)
    scores = spark.createDataFrame([(0, 0, 0, 0.5), (0, 1, 0, 0.5), (1, 0, 1, 0.1), (1, 1, 1, 0.9)], "row int, action int, truth int, score double")
    r = metrics.action_ranking(scores, row="row", action="action", true_action="truth", score="score").head()
    assert (r.row_count, r.mrr, r.top1_rate) == (2, 0.75, 0.5)
    assert {tuple(x) for x in metrics.best_action(scores, row="row", action="action", score="score").collect()} == {(0, 0), (1, 1)}
    pairs = spark.createDataFrame([(k, 0.0, 1.0 + (k % 3 - 1) * 0.1) for k in range(60)], "key long, baseline double, candidate double")
    b = metrics.bootstrap_interval(pairs, seed=1, samples=400).head()
    assert b.pairs == 60 and b.lower < b.mean_difference < b.upper and 0.95 < b.lower and b.upper < 1.05
    assert metrics.loss_summary(spark.createDataFrame([(1, 2.0), (2, 1.0)], "step int, loss double")).head()[:] == (2, 2.0, 1.0, 1.0, True)


def test_binary_planes_agree_with_arrays(spark):
    planes = [bytes([1, 2, 3, 4]), bytes([0, 0, 0, 0]), bytes([1, 9, 3, 4]), bytes([0, 0, 0, 0]), bytes([1, 9, 9, 4]), bytes([0, 0, 0, 0])]
    names = ["current_chars", "current_colors", "next_chars", "next_colors", "pred_chars", "pred_colors"]
    r = metrics.binary_plane_sums(spark.createDataFrame([tuple(map(bytearray, planes))], ", ".join(f"{n} binary" for n in names)), map_cells=2).head()
    ints = lambda k: F.array(*[F.lit(x) for x in planes[k]])
    a = spark.range(1).select(*metrics.plane_sums(ints(0), ints(2), ints(4), 2)).head()
    for c in ("cells", "char_correct", "exact_frames", "true_changed", "predicted_changed", "correct_changed", "true_positive_changed", "map_char_correct", "status_char_correct"):
        assert r[c] == a[c], c


def test_comparison_and_gate(spark):
    value = lambda *rows: spark.createDataFrame(list(rows), "metric string, value double")
    told = compare.compared(value(("x", 0.1), ("y_mae", 2.0), ("gone", 1.0)), value(("x", 0.3), ("y_mae", 3.0)))
    assert {r.metric: (r.improved, r.regressed) for r in told.collect()} == {"x": (True, False), "y_mae": (False, True)}
    assert compare.score_to_beat(told).head().verdict == "mixed"
    wanted = spark.createDataFrame([("a", "x", "improved"), ("b", "gone", "improved")], "name string, metric string, mode string")
    assert compare.gate(compare.requirements(wanted, told)).head().verdict == "missing"
    evidence = spark.createDataFrame([("r", "next_1_frame_sequence_window_count", 0.0)], "run string, metric string, value double")
    assert compare.sequence_evidence(evidence, [1]).count() == 2


def test_registry(spark, tmp_path):
    entry = {"benchmark_id": "a", "lane": "l", "protocol_id": "p", "comparison": "candidate_lower_at_least_target_estimate", "candidate_metric": "m", "source": "s", "required_for_competitive": True, "target": {"estimate": 2.0, "lower": 1.0}}
    other = entry | {"benchmark_id": "b", "comparison": "reference_only", "required_for_competitive": False}
    path = tmp_path / "registry.json"
    path.write_text(json.dumps({"schema_version": "v", "captured_at": "t", "benchmarks": [entry, other], "competitive_definition": {"required_external_benchmark_ids": ["a"]}}))
    registry = readers.benchmark_registry(spark, str(path))
    assert compare.registry_failures(registry).count() == 0
    candidate = spark.createDataFrame([("m", 3.0, 2.5, 4.0)], "metric string, estimate double, lower double, upper double")
    told = compare.benchmark_comparison(registry, candidate, ["p"])
    assert {r.benchmark_id: (r.status, r.passed) for r in told.collect()} == {"a": ("passed", True), "b": ("reference_only", None)}
    assert compare.competitive(told, True).head()[0] and not compare.competitive(told, False).head()[0]
    assert {r.status for r in compare.benchmark_comparison(registry, candidate, []).collect()} == {"protocol_not_run", "reference_only"}


def watch(spark, *rows):
    base = dict(run_id="r", seed=0, character="c", step=0, side="current", action_id=0, reward=0.0, cumulative_reward=0.0, done=False, death=None, score=0, hp=10, depth=1, prompt_score=0, prompt_hp=10, prompt_depth=1, message="", hunger=None, menu_open=None, game_time_advanced=True, terminal_frame=None, prompt_terminal_frame=None, policy_observation_text=None, policy_user_prompt="p")
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schemas.WATCH_EVENT)


def test_episode_summary(spark):
    rows = watch(spark, dict(step=0), dict(step=1, score=5, reward=5.0, cumulative_reward=5.0, action_id=1), dict(step=2, score=5, message="a wall", cumulative_reward=5.0), dict(step=3, score=9, message="solid stone", cumulative_reward=5.0, death="fell"))
    r = rollouts.summaries(rows).head()
    assert (r.event_count, r.step_count, r.score_delta, r.wall_message_count, r.live_progress_event_count, r.dirty_live_progress_event_count, r.zero_progress_episode) == (4, 4, 9, 2, 1, 1, 0)
    assert r.fitness_components.death == -8.0 and r.fitness_components.wall_message_rate == -1.25
    assert r.fitness_score == pytest.approx(sum(r.fitness_components))
    empty = rollouts.summaries(rows.limit(0))
    assert empty.count() == 0


def test_preferences(spark):
    rows = watch(
        spark, dict(side="current", action_id=1, message="a wall", game_time_advanced=False), dict(side="baseline", action_id=2, reward=1.0), dict(step=1, side="current"), dict(step=1, side="baseline"),
        dict(step=2, side="current", action_id=1), dict(step=2, side="baseline", action_id=2, policy_user_prompt="q"), dict(step=3, side="current", action_id=None), dict(step=3, side="baseline"),
        dict(step=4, side="current", action_id=1), dict(step=4, side="baseline", action_id=2),
    )
    got = rollouts.preferences(rows).orderBy("step").collect()
    assert [r.skip_reason for r in got] == [None, "same_action", "divergent_prompt", "missing_action", "utility_tie"]
    assert (got[0].chosen_side, got[0].chosen, got[0].rejected) == ("baseline", '{"action_id": 2}', '{"action_id": 1}')


def test_similarity_of_different_lengths(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [1, 3, 4]), (2, [1, 2]), (3, [])], "k int, a array<int>")
    r = rollouts.sequence_similarity(rows, key="k", actions="a").head()
    # pairs: (0,1) 1/3, (0,2) 1, (1,2) 1/3, and three with the empty one 0
    assert (r.pair_count, r.equal_pairs, r.mean_similarity) == (6, 1, round((1 / 3 + 1 + 1 / 3) / 6, 6))


def test_shuffled_pairs_wrap(spark):
    rows = spark.createDataFrame([("g", k, "a" if k % 3 else "b") for k in range(9)] + [("h", 99, "a")], "g string, k int, l string")
    got = compare.shuffled_pairs(rows, group=["g"], key="k", label="l", seed=3).collect()
    assert len(got) == 9 and all(r.l != r.other_label for r in got)


def test_splits(spark):
    rows = splits.with_split(spark.range(200), "id", 7)
    assert {r.split for r in rows.collect()} == {"train", "validation", "test"}
    assert splits.bernoulli(rows, "id", 1, 0.0).count() == 0 and splits.bernoulli(rows, "id", 1, 1.0).count() == 200
    assert splits.exact_sample(rows, "id", 1, 17).count() == 17
    leaked = rows.union(spark.createDataFrame([(0, "x")], "id long, split string"))
    assert splits.overlaps(leaked, "id").count() == 1


def test_manifests(spark, tmp_path):
    for text in ('[{"shard_tar": "a.tar", "shard_db": "/x/a.db"}]', '{"shards": [{"shard_tar": "a.tar", "shard_db": "/x/a.db"}]}', '{"shard_tar": "a.tar", "shard_db": "/x/a.db"}\n'):
        path = tmp_path / "m.json"
        path.write_text(text)
        r = readers.archive_manifest(spark, str(path)).head()
        assert (r.shard_index, r.shard_tar, r.shard_db) == (0, f"{tmp_path}/a.tar", "/x/a.db")
    path.write_text('{"shard_tar": "a.tar"}')
    with pytest.raises(Exception, match="shard_db"):
        readers.archive_manifest(spark, str(path)).collect()
    games = [spark.createDataFrame([(1, "a")], "gameid int, role string"), spark.createDataFrame([(1, "b"), (2, "c")], "gameid int, role string")]
    assert {(r.gameid, r.role) for r in readers.archive_plan(games).collect()} == {(1, "b"), (2, "c")}


def test_readiness(spark):
    cases = [(3, None, "probably_labelled"), (1, None, "frame_only"), (3, ["tty_chars"], "frame_only"), (1, ["actions"], "labelled")]
    rows = spark.createDataFrame([c[:2] for c in cases], "v int, k array<string>")
    assert [r.s.status for r in rows.select(readers.label_readiness(F.col("v"), F.col("k")).alias("s")).collect()] == [c[2] for c in cases]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("train", "policy_action", 1), ("test", "next_frame", 2)], "split string, task string, n int")
    writers.write_rows(rows, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).filter("split = 'test'").head().n == 2
    assert writers.report_text(rows.limit(1)) == '{\n  "n": 1,\n  "split": "train",\n  "task": "policy_action"\n}\n'
    writers.write_report(rows.limit(1), str(tmp_path / "report"))
    assert writers.concatenated([rows.withColumn("ordinal", F.lit(k)) for k in (0, 1)], 3).count() == 3
    nested = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.lit(True).alias("b")).alias("s"), F.lit("x").alias("t"))
    assert {tuple(r) for r in compare.flat_numbers(nested).collect()} == {("s/a", 1.0), ("s/b", 1.0)}
