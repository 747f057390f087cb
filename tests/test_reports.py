"""Limits, dataset folders, planes, bootstrap weights and reports: errors and what SQL can't say."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import scalars
from tracemill.operators import build, metrics, planes, reports, splits, transitions
from tracemill.plans import queries as plans
from tracemill.sources import readers, writers
from tracemill.streaming import ledger

from .conftest import SMALL

ACTIONS = [(0, "a"), (1, "b")]


def rows(spark, n=30):
    made = [(s, t, g, g * 2, [("system", "s"), ("user", f"Current observation:\nu{g}"), ("assistant", "x")]) for g in range(n) for s in [build.SPLITS[g % 3]] for t in build.TASKS]
    return spark.createDataFrame(made, "split string, task string, gameid long, step int, messages array<struct<role: string, content: string>>")


def test_limits():
    build.limit_contract(5, None)
    build.limit_contract(None, {"train": 1, "validation": 1, "test": 1})
    for bad in ((5, {"train": 1, "validation": 1, "test": 1}), (0, None), (None, {"train": 1}), (None, {"train": 1, "validation": 0, "test": 1})):
        with pytest.raises(ValueError):
            build.limit_contract(*bad)


def test_unreached_limits_fail_a_job(spark):
    counts = rows(spark).groupBy("split", "task").agg(F.count("*").alias("n"))
    good = build.limit_status(counts, {"train": 10, "validation": 9, "test": 1})
    assert good.filter("all_reached").count() == 6 and build.required_limits(good).filter("reached").count() == 6
    bad = build.limit_status(counts, {"train": 11, "validation": 9, "test": 1})
    assert bad.filter("all_reached").count() == 0
    with pytest.raises(Exception, match="limit of train"):
        build.required_limits(bad).collect()


def test_dataset_folders(spark, tmp_path):
    own = {"dataset_name": "d", "mode": "m", "env_id": "e", "label_source": "l", "actions": ACTIONS}
    build.write_dataset(rows(spark), f"{tmp_path}/whole", **own)
    build.write_dataset(rows(spark), f"{tmp_path}/limited", limits={"train": 3, "validation": 2, "test": 50}, **own)
    build.write_dataset(rows(spark), f"{tmp_path}/few", max_rows=7, **own)
    read = lambda name, **k: readers.eval_rows(spark, f"{tmp_path}/{name}", **({"split": "train", "tasks": build.TASKS, "mode": "m", "env_id": "e", "actions": ACTIONS} | k))
    assert read("whole").count() == 20 and read("limited").count() == 6 and read("limited", split="test").count() == 20
    assert readers.dataset_summary(spark, f"{tmp_path}/few").select("accepted_rows", "row_count", "rejected_rows").head() == (7, 7, 0)
    for wrong in ({"split": "all"}, {"mode": "x"}, {"env_id": "x"}, {"actions": ACTIONS[:1]}, {"tasks": ["other"]}):
        with pytest.raises(ValueError):
            read("whole", **wrong)
    assert readers.file_entries(spark, f"{tmp_path}/few/manifest").filter("name LIKE '%.json' AND size_bytes > 0").count() >= 1
    prints = readers.fingerprints(spark, f"{tmp_path}/few/manifest/*.json")
    assert prints.filter("length(sha256) = 64").count() == prints.count() >= 1


def test_newest_reports_leave_malformed_ones_out(spark, tmp_path):
    for name, text in (("a", '{"score": 1}'), ("b", "{broken"), ("c", '{"score": 3}')):
        (tmp_path / f"{name}.json").write_text(text)
    found = readers.newest_reports(spark, f"{tmp_path}/*.json", "score int", 5).select("score").collect()
    assert {r.score for r in found} == {1, 3}


def test_sources_in_memory(spark):
    roots = spark.createDataFrame([("d", "/old", 3)], "dataset_name string, root string, ttyrec_version int")
    assert writers.with_new_root(roots, "/new").head().root == "/new"
    a = spark.createDataFrame([("train", 1), ("test", 2)], "split string, gameid long")
    assert sorted(map(tuple, build.merge_splits([a, a.filter("gameid = 1")]).collect())) == [("test", 2), ("train", 1)]
    plan = readers.archive_plan([a.select("gameid"), a.filter("gameid = 2").select("gameid")])
    assert [r.gameid for r in readers.games_of(plan, 1).collect()] == [2]
    manifest = spark.createDataFrame([(1, 7), (0, 9)], "ordinal int, action_id int")
    assert readers.valid_actions(manifest).head().valid_action_ids == [9, 7]


def test_player_index_is_bucketed(spark):
    recordings = spark.createDataFrame([("p", "p/1"), ("q", "q/2")], "player string, path string")
    try:
        writers.save_player_index(recordings, "player_index", buckets=2)
        assert spark.table("player_index").count() == 2
        assert any("Num Buckets" in r.col_name and r.data_type == "2" for r in spark.sql("DESCRIBE EXTENDED player_index").collect())
    finally:
        spark.sql("DROP TABLE IF EXISTS player_index")


@pytest.mark.parametrize("text", ["0", "1,x", "", "-3"])
def test_wrong_horizons_fail(spark, text):
    with pytest.raises(Exception, match="horizons must be positive"):
        spark.range(1).select(scalars.horizon_list(F.lit(text))).collect()


def test_wrong_names_fail(spark):
    with pytest.raises(Exception, match="unknown or no names"):
        spark.range(1).select(scalars.name_list(F.lit("a,c"), ["a", "b"])).collect()


def test_ranks_by_range_are_whole_ranks(spark):
    frame = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    position = scalars.hash_bucket(1, F.col("id"))
    got = {r.id: r.rank for r in splits.ranked(frame, groups=["g"], position=position, order=["id"], alias="rank").collect()}
    placed = sorted((r.g, r.p, r.id) for r in frame.select("*", position.alias("p")).collect())
    want, last, n = {}, None, 0
    for g, _, key in placed:
        n = n + 1 if g == last else 0
        want[key], last = n, g
    assert got == want
    assert splits.ranked(frame.limit(0), groups=["g"], position=position, order=["id"], alias="rank").count() == 0
    assert transitions.dense_numbers(frame.limit(0), key="g", order=["id"]).count() == 0
    assert splits.share_sample(frame, "id", 1, 0.25).count() == 125


def test_bootstrap_query_is_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    keys = np.array([r.vec_id for r in rows])
    d = np.array([float(r.embedding[1]) - float(r.embedding[0]) for r in rows])
    weights = metrics.poisson_weights(plans.SEED, keys, 1000)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05
    means = (weights * d[:, None]).sum(axis=0) / weights.sum(axis=0)
    got = plans.QUERIES["bootstrap"](spark, SMALL).head()
    assert got.pairs == len(rows) and got.mean_difference == pytest.approx(d.mean())
    assert (got.lower, got.upper) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))


def test_too_few_candidates_fail(spark):
    actions = spark.createDataFrame([(1, "a"), (2, "b")], "id long, action string")
    assert planes.candidates(actions, actions, row="id", action="action", count=2).count() == 4
    with pytest.raises(Exception, match="too few actions"):
        planes.candidates(actions, actions, row="id", action="action", count=3).collect()
    with pytest.raises(ValueError):
        planes.candidates(actions, actions, row="id", action="action", count=1)


def test_planes_of_different_sizes_fail(spark):
    bad = spark.createDataFrame([(0, b"ab", b"ab", b"ab", b"a")], "split_code int, current_chars binary, current_colors binary, next_chars binary, next_colors binary")
    with pytest.raises(Exception, match="plane is missing"):
        planes.checked(bad).collect()


def test_rollouts_end_with_their_actions(spark):
    starts = spark.createDataFrame([(1, "ab", [1, 2]), (2, "", []), (3, "c", None)], "k long, frame string, actions array<int>")
    out = metrics.predicted_rollouts(starts, lambda frames, actions: [f"{f}{a}" for f, a in zip(frames, actions, strict=True)], key=["k"])
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, "ab1"), (1, 2, 2, "ab12")]


def test_best_report_prefers_the_prefix(spark):
    frame = spark.createDataFrame([(1, "old", 9.0), (1, "new-a", None), (1, "new-b", 0.0), (2, "old", None)], "lane int, run string, score double")
    got = {r.lane: r.run for r in reports.best_report(frame, run="run", value="score", prefix="new-", key=["lane"]).collect()}
    assert got == {1: "new-a", 2: "old"}


def test_streams_give_the_last_row_of_each_key(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "name string, ordinal long, status string").write.json(source)
    spark.createDataFrame([("a", 2, "z")], "name string, ordinal long, status string").write.mode("append").json(source)
    schema = spark.read.json(source).schema
    found = ledger.run_to_end(ledger.latest_status(ledger.stream(spark, source, schema, files_per_batch=1)), ["name"])
    assert sorted(map(tuple, found.collect())) == [("a", "z"), ("b", "y")]
