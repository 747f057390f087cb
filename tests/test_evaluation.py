"""One evaluation equals the separate metrics of each grain, from one scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import evaluation, metrics, planes

GRAINS = [[], ["game"], ["horizon"], ["game", "horizon"]]


@pytest.fixture(scope="module")
def examples(spark, tmp_path_factory):
    rng, rows = random.Random(4), []
    for k in range(60):
        current = [[rng.randrange(4) for _ in range(12)] for _ in range(2)]
        near = lambda p: [v if rng.random() < 0.8 else rng.randrange(4) for v in p]
        rows.append((rng.choice([None, 1, 2, 3]), rng.choice([1, 4]), *current, *map(near, current), *map(near, current)))
    fields = ", ".join(["game long", "horizon int", *[f"{s}_{k} array<int>" for s in ("current", "next", "pred") for k in ("chars", "colors")]])
    path = str(tmp_path_factory.mktemp("planes") / "rows")
    spark.createDataFrame(rows, fields).write.parquet(path)
    return spark.read.parquet(path)


def separate(rows):
    """The figures of one group by the operators for one grain."""
    sums = rows.select(*metrics.plane_sums(F.col("current_chars"), F.col("next_chars"), F.col("pred_chars"), 8))
    return metrics.plane_metrics(sums).head().asDict() | {"mean_example_f1": round(rows.agg(F.avg(planes.changed_f1())).head()[0], 6)}


def test_every_grain_equals_its_own_metrics(examples):
    got = {(r["grain"], r["game"], r["horizon"]): r.asDict() for r in evaluation.evaluated(examples, GRAINS, map_cells=8).collect()}
    assert {g for g, _, _ in got} == {"all", "game", "horizon", "game,horizon"} and ("game", None, None) in got
    for (grain, game, horizon), found in got.items():
        rows = examples
        if "game" in grain:
            rows = rows.filter(F.col("game").eqNullSafe(F.lit(game)))
        if "horizon" in grain:
            rows = rows.filter(F.col("horizon") == horizon)
        want = separate(rows)
        assert {k: found[k] for k in want} == pytest.approx(want, abs=2e-6)
    assert sum(r["examples"] for k, r in got.items() if k[0] == "game,horizon") == 60


def test_one_scan(examples):
    plan = evaluation.evaluated(examples, GRAINS, map_cells=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_all_rows_alone_and_none(examples):
    (row,) = evaluation.evaluated(examples, [[]], map_cells=8).collect()
    assert row.grain == "all" and row.examples == 60
    assert evaluation.evaluated(examples.filter("false"), GRAINS, map_cells=8).count() == 0
