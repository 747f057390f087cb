import pytest
from pyspark.sql import functions as F

from tracemill.functions import scalars
from tracemill.operators import compare, metrics, reports, rollouts, splits, transitions
from tracemill.sources import readers, shapes


def test_first_failure_is_told(spark):
    row = "run_id string, ordinal int, stage string, error_type string, error_message string, contract_path string, mode string, tracker string"
    attempts = spark.createDataFrame(
        [("a", 1, "setup", None, None, "c", "online", None), ("a", 3, "step", "ValueError", "late", "c", "online", "{}"), ("a", 2, "step", "KeyError", None, "c", "online", ""), ("b", 1, "setup", None, "x", "c", "online", None)], row
    )
    got = reports.failure_reports(attempts).collect()
    assert [(r.run_id, r.status, r.failure_stage, r.error_type, r.error_message, r.tracker) for r in got] == [("a", "failed", "step", "KeyError", "", None)]
    assert reports.failure_reports(attempts.limit(0)).count() == 0


def test_versions_of_other_kinds_are_passed_over(spark):
    texts = ['{"rollout_metrics": {"current": {"fitness_objective_version": 3}, "baseline": {"fitness_objective_version": "b"}}}', '{"rollout_metrics": 5}', "{", None, '{"rollout_metrics": {"current": {"fitness_objective_version": ""}}}']
    rows = shapes.parsed(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t")
    assert [r.v for r in rows.orderBy("k").select(shapes.objective_version(F.col("report"), "own").alias("v")).collect()] == ["b", "own", "own", "own", "own"]


def test_contexts_of_pairs_and_objects(spark):
    texts = ['[["a\\"b", 2], {"x": [1]}]', "[]", "7", None, '[[null, "4"]]']
    rows = shapes.parsed(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t")
    got = [r.c for r in rows.orderBy("k").select(shapes.context_text(F.col("report")).alias("c")).collect()]
    assert got == ['[{"observation_text":"a\\"b","action_id":2},{"x":[1]}]', "[]", None, None, '[{"observation_text":"None","action_id":4}]']
    with pytest.raises(Exception, match="(?i)cast"):
        shapes.parsed(spark.createDataFrame([('[["a", "b"]]',)], "t string"), "t").select(shapes.context_text(F.col("report"))).collect()


@pytest.mark.parametrize("given", [(None, None, None), (None, "r", None), ("i", None, "m"), (None, "r", "m")])
def test_wrong_sources_fail(spark, given):
    rows = spark.createDataFrame([given], "i string, r string, m string")
    with pytest.raises(Exception, match="a manifest can't|a run needs"):
        rows.select(readers.dataset_source(F.col("i"), F.col("r"), F.col("m"))).collect()


def wide(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))


@pytest.mark.parametrize("partitions", [4, 211])
def test_ranges_rise_with_the_partitions(spark, partitions):
    try:
        wide(spark, partitions)
        rows = spark.range(3000).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 17 = 0 THEN NULL ELSE id * 31 % 1009 END").cast("double").alias("at"), (F.col("id") % 900).alias("k"))
        assert splits.range_count(rows) == max(64, partitions)
        got = {r.k: r.n for r in transitions.dense_numbers(rows, key="k", order=["at", "id"], alias="n").collect()}
        first = {}
        for r in rows.collect():
            first[r.k] = min(first.get(r.k, (True, float("inf"), 0)), (r["at"] is not None, r["at"] or 0.0, r.id))
        assert got == {k: n for n, k in enumerate(sorted(first, key=first.get))}
    finally:
        wide(spark, 4)


@pytest.mark.parametrize("partitions", [4, 211])
def test_shuffled_pairs_are_the_next_of_another_label(spark, partitions):
    # long runs over many ranges, a group of one label, one without, and null as a label
    rows = [("g", k, "ab"[k % 40 == 0]) for k in range(600)] + [("h", k, "a") for k in range(600, 700)] + [(None, 800, "a"), ("n", 901, None), ("n", 902, "a"), ("n", 903, None)]
    try:
        wide(spark, partitions)
        frame = spark.createDataFrame(rows, "g string, k int, l string")
        placed = frame.withColumn("p", scalars.hash_bucket(3, F.col("k"))).collect()
        want = {}
        for g in ("g", "h", "n"):
            own = sorted((r for r in placed if r.g == g), key=lambda r: (r.p, r.k))
            for i, r in enumerate(own):
                found = [o for o in own[i + 1 :] + own[:i] if o.l != r.l]
                if found:
                    want[r.k] = (found[0].k, found[0].l)
        got = {r.k: (r.other_key, r.other_label) for r in compare.shuffled_pairs(frame, group=["g"], key="k", label="l", seed=3).collect()}
        assert got == want
    finally:
        wide(spark, 4)


def test_similarity_of_rows_is_that_of_arrays(spark):
    of = {0: [1, 2, 3], 1: [1, 2, 3], 2: [2, 1, 3], 3: [1, None, 3], 4: [1, None, 3], 5: [3], 6: [1, 2, 3, 4, 5, 6]}
    arrays = spark.createDataFrame(list(of.items()), "k int, a array<int>")
    steps = arrays.select("k", F.posexplode("a").alias("at", "x"))
    got = rollouts.step_similarity(steps, key="k", place="at", action="x").head()
    assert got == rollouts.sequence_similarity(arrays, key="k", actions="a").head() and (got.pair_count, got.equal_pairs) == (21, 2)
    none = rollouts.step_similarity(steps.limit(0), key="k", place="at", action="x").head()
    assert (none.pair_count, none.equal_pairs) == (0, 0)


def test_dominant_action_ties_go_to_the_smallest(spark):
    rows = spark.createDataFrame([("b", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", None)], "label string, prediction string")
    got = metrics.policy_metrics(rows, F.lit(True)).head()
    assert (got.target_dominant, got.predicted_dominant) == ("a", "b")


def test_halves_of_scores_round_up_in_any_order(spark, tmp_path):
    import random
    from functools import reduce

    from tracemill.plans import queries as plans

    def given(seed):
        rng = random.Random(seed)
        return [rng.randrange(1, 40_000) for _ in range(64)]

    # the first values whose mean is a half of the sixth place, and less if doubles are summed
    cents = next(c for c in map(given, range(10_000)) if sum(c) % 4 == 2 and reduce(float.__add__, [x / 100 for x in c]) / 64 < sum(c) / 6400)
    values, want = [x / 100 for x in cents], (sum(cents) * 10_000 // 64 + 1) / 10**6
    for name, order in (("one", values), ("other", values[::-1])):
        spark.createDataFrame([(0, v) for v in order], "user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        assert [tuple(r) for r in plans.QUERIES["best_reports"](spark, f"{tmp_path}/{name}").collect()] == [(0, "corrected-0", want)]


def test_means_of_other_doubles(spark):
    rows = spark.createDataFrame([("third", 1 / 3), ("third", 2 / 3), ("large", 1e300), ("nan", float("nan")), ("nan", 1.0), ("null", None), ("some", None), ("some", 0.5)], "k string, x double")
    got = {r.k: r.m for r in rows.groupBy("k").agg(scalars.mean(F.col("x")).alias("m")).collect()}
    assert got.pop("nan") != 1.0 and got == {"third": 0.5, "large": 1e300, "null": None, "some": 0.5}


def test_best_reports_and_ties(spark):
    rows = spark.createDataFrame([(1, "run-9", 9.0), (1, "corrected-2", None), (1, "corrected-1", 0.0), (2, "run-b", -1.0), (2, "run-a", -1.0), (3, "corrected-1", -1.0), (3, "corrected-2", None)], "lane int, run string, score double")
    got = reports.best_report(rows, run="run", value="score", prefix="corrected-", key=["lane"]).collect()
    assert sorted(map(tuple, got)) == [(1, "corrected-1", 0.0), (2, "run-a", -1.0), (3, "corrected-2", None)]
