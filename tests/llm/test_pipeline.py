"""The pipeline: its contract, and its stages on a small table with copies."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_duplicates import near, removed
from tracemill.llm import mixing

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, []
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.common.written(stage(spark, docs, DATA), name.replace(" ", "-"))
        rows.append((name, docs.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "line dedup":
            own = [(r.doc_id, r.text) for r in before.collect()]
            gone = removed(own)
            left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in own}
            assert {r.doc_id: r.text for r in docs.collect()} == {i: t for i, t in left.items() if t.split()}
        if name == "mixing":
            plan = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == plan
        if name == "MinHash near-dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert len(texts) == rows[-1][1]
            _, component = near(texts, 5)
            assert all(component[i] == i for i in texts)
    assert docs.filter("NOT decoded_ok").count() == 0 and rows[0][1] <= 200 and rows[-1][1] == rows[-2][1] > 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.lit(False))
    assert stage(spark, docs, DATA).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
