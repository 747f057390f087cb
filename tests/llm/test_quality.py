"""Quality rules and the rule ensemble: brute force, held-out accuracy, monotony, odd inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tracemill.llm import common, quality_classifier, quality_rules, queries, trees

DATA = "/root/testdata/sf0.01"
TEXTS = [None, "", " \n\t", "a b a b a b", "x\nx\n\nx\ny", "# $ a|b\n<c> * &", "the\xa0end é ü", "word " * 60, "one two three " * 40]


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if times[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_are_those_of_brute_force(text):
    assert quality_rules.statistics(None if text is None else text.encode())[0] == counted(text)


def test_rules_over_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op10_quality_rules(spark, DATA).toPandas().set_index("doc_id")
    assert len(got) == docs.count()
    for r in docs.select("doc_id", "text").limit(200).collect():
        row = got.loc[r.doc_id]
        want = counted(r.text)
        assert [row[c] for c in quality_rules.BASE] == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (row.base_failed and row.kept)
    labels = pd.read_parquet(f"{DATA}/labels.parquet").groupby("doc_id").quality.max()
    both = got[~got.base_failed].join(labels, how="inner")
    assert (both.kept == (both.quality == 1)).mean() > 0.97


def test_scores_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(800) > 0.5).astype(float)
    model = trees.fit(x, y, rounds=30, monotone={0: -1, 1: 1})
    grid = np.repeat(rng.random((50, 1, 3)), 30, axis=1)
    for f, sign in ((0, -1), (1, 1)):
        g = grid.copy()
        g[:, :, f] = np.linspace(0, 1, 30)
        score = model.score(g.reshape(-1, 3)).reshape(50, 30)
        assert (np.diff(score, axis=1) * sign >= -1e-12).all()


def test_trees_match_a_walk_over_their_nodes():
    rng = np.random.default_rng(1)
    x = rng.random((300, 4))
    model = trees.fit(x, (x[:, 1] > 0.4).astype(float), rounds=5)

    def walk(row):
        out = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            out += model.value[node]
        return out

    assert np.allclose(model.margin(x), [walk(r) for r in x])
    assert trees.fit(x, np.ones(300)).score(x).std() == 0 and 0 < trees.fit(x[:0], np.empty(0)).score(x)[0] < 1


def test_paths_hold_where_the_tree_goes():
    rng = np.random.default_rng(2)
    x = rng.random((200, 3))
    model = trees.fit(x, (x[:, 0] > x[:, 1]).astype(float), rounds=1, depth=2)
    leaves = [r for r in trees.rules(model) if len(r)]
    assert leaves and trees.satisfied(leaves, x).any(axis=0).all()


def test_lasso_leaves_few_rules():
    rng = np.random.default_rng(3)
    r = (rng.random((500, 20)) > 0.5).astype(float)
    y = (r[:, 4] > 0).astype(float)
    _, w = trees.lasso_logistic(r, y, 0.01)
    assert np.argmax(np.abs(w)) == 4 and (np.abs(w) > 1e-9).sum() < 10


def test_classifier_on_the_held_out_fold(spark):
    data = DATA.replace("sf0.01", "sf0.1")  # the fold of the smaller table has 70 labels only
    got = queries.op5_quality_classifier(spark, data).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = pd.read_parquet(f"{data}/labels.parquet").groupby("doc_id").quality.max()
    fold = got[got.held_out].merge(labels.rename("q"), left_on="doc_id", right_index=True)
    assert (fold.predicted == fold.q).mean() > 0.97


def odd(spark):
    return spark.createDataFrame([(1, None, "x"), (1, "a", None), (None, "b " * 100, "y"), (2, "", "z")], "doc_id long, text string, score string")


def test_odd_rows(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, 0), (1, 1, 0), (1, 0, 0), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rules = quality_rules.apply(docs, quality_rules.fit(docs, labels))
        assert rules.count() == 4 and rules.filter("base_failed").count() == 4
        scored = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).toPandas()
        assert len(scored) == 4 and scored.score.between(0, 1).all() and not scored.held_out.isna().any()
    kept = quality_rules.kept_documents(docs, quality_rules.fit(docs, none))
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality_rules.apply(docs.limit(0), quality_rules.fit(docs, none)).count() == 0
    assert quality_classifier.classify(docs.limit(0), quality_classifier.fit(docs, none)).count() == 0


def test_rules_compile_to_columns(spark):
    x = np.array([[0.5] * len(quality_classifier.STATISTICS), [2.0] * len(quality_classifier.STATISTICS)])
    rule = ((0, -np.inf, 1.0), (1, 0.2, np.inf))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in quality_classifier.STATISTICS))
    got = [r.s for r in frame.select(quality_classifier.compile_rules([rule], np.array([2.0]), -1.0).alias("s")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(trees.satisfied([rule], x)[:, 0] * 2.0 - 1.0))))


def plain_statistics(text):
    """STATISTICS of a text, counted character by character."""
    t = text or ""
    size, data = max(len(t.encode()), 1), t.encode()
    words, lines = t.replace("\n", " ").count(" ") + 1, t.split("\n")
    count = lambda chars: sum(c in chars for c in t)
    return [
        np.log1p(len(data)), len(data) / words, count("#*$%&<>") / size, count("!") / size, sum("A" <= c <= "Z" for c in t) / size, 1 - len(set(lines)) / len(lines),
        len(set(t.split(" "))) / words, words / len(lines), count("|") / size, 1 - len(t) / size, len(re.findall("[0-9]+", t)) / size,
    ]


def test_classifier_query_is_brute_force(spark):
    """Every score of the query, from the statistics of whole texts and the fitted rules."""
    small = DATA.replace("sf0.01", "sf0.001")
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rules, weights, intercept = quality_classifier.fit(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    x = np.array([plain_statistics(r.text) for r in rows])
    want = dict(zip([r.doc_id for r in rows], 1 / (1 + np.exp(-(trees.satisfied(rules, x) @ weights + intercept))), strict=True))
    got = queries.op5_quality_classifier(spark, small).collect()
    assert len(got) == len(rows) and all(r.score == pytest.approx(want[r.doc_id], abs=1e-12) for r in got)


def test_rules_on_a_held_out_fold(spark):
    data = DATA.replace("sf0.01", "sf0.1")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    held = common.held_out(F.col("doc_id"))
    model = quality_rules.fit(docs, labels.filter(~held))
    got = quality_rules.apply(docs.filter(held), model).toPandas().set_index("doc_id")
    truth = pd.read_parquet(f"{data}/labels.parquet").groupby("doc_id").quality.max()
    both = got[~got.base_failed].join(truth, how="inner")
    assert len(both) > 100 and (both.kept == (both.quality == 1)).mean() > 0.95


def test_very_long_texts(spark):
    text = "one two three four\n" * 30_000
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rules = {r.doc_id: r for r in quality_rules.apply(docs, quality_rules.fit(docs, none)).collect()}
    assert [rules[1][c] for c in quality_rules.BASE] == counted(text)
    row = quality_classifier.with_statistics(docs).filter("doc_id = 1").head()
    assert np.allclose([row[c] for c in quality_classifier.STATISTICS], plain_statistics(text))
