"""Mixing against its SQL, and odd inputs."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import same_rows
from tracemill.llm import mixing, queries

DATA = "/root/testdata/sf0.01"


def test_mix_matches_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert same_rows(queries.op6_mixing(spark, DATA).toPandas(), duck.sql(mixing.MIX_SQL).df())


def test_targets_are_met(spark):
    rows = queries.op6_mixing(spark, DATA).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all() and (rows.taken == rows.copies * rows["size"]).all()
    by = rows.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert by.target.sum() == pytest.approx(1.5 * rows["size"].sum())


def test_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), (None, 10)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (1, 1, 1), 1.0, 2.0).collect()}
    assert got == {"a": 80.0, "b": 20.0, None: 20.0}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "p"), (2, "", "s", "q"), (3, "a b", "s", "r"), (3, "a b", "s", "r"), (None, "c # d", None, "t")], "doc_id long, text string, source string, target string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 5 and all(r.taken <= 2 * r.size for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() >= 1
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]


def test_reruns_agree(spark):
    a, b = (queries.op6_mixing(spark, DATA).toPandas().sort_values("doc_id", ignore_index=True) for _ in range(2))
    assert a.equals(b)


def test_the_mix_has_the_words_of_its_plan(spark):
    """Rows of one id with different texts and copies, equal rows at a boundary, and columns with clashing names."""
    rows = [(k % 7, " ".join(["w"] * (1 + k % 5)) + (" #" if k % 3 else ""), "ab"[k % 2], k) for k in range(60)] + [(9, "x y", "a", 0)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark long")
    for share in (0.7, 1.0, 1.5):
        plan = mixing.mix(docs, share=share).toPandas()
        mixed = mixing.mixed_documents(docs, share=share).toPandas()
        assert list(mixed.columns) == docs.columns and len(mixed) == plan.copies.sum()
        words = mixed.text.str.count(mixing.WORD)
        assert words.groupby(mixed.source).sum().to_dict() == plan.groupby("source").taken.sum().to_dict()


def test_ranges_are_small_whatever_the_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 9 = 0, 'plain words', repeat('#', 40)) AS text", "'s' AS source")
    keyed = mixing._plan(docs)
    assert keyed.count() == 20_000
    text = mixing.F.col("text")
    size, symbols = mixing.word_count(text), mixing.symbol_count(text)
    key = -mixing.F.log(mixing.uniform("mix", mixing.F.col("doc_id"))) / ((size + 1) / (size + 1 + 4 * symbols))
    most = docs.groupBy(mixing.F.floor(mixing.F.log2(key) * 256).alias("bin")).count().agg({"count": "max"}).first()[0]
    assert most <= 2 * 0.00255 * 20_000


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "s"), (2, "a b", "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {1: 300_000, 2: 2}
