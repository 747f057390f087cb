"""A build in steps: the rows of a row-by-row build, later shards unopened, and going on after a kill."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracemill.operators import build, progressive

SCHEMA = "gameid long, ordinal long, split string, n_actions int, next_value string"


def row_by_row(rows: list[tuple], limits: dict | None, max_rows: int | None, tasks) -> dict:
    """Counters and accepted rows of a build that looks at one row at a time."""
    counts, rejected, kept, processed, skipped = {}, {}, [], 0, 0
    full = lambda s, t: limits is not None and counts.get((s, t), 0) >= limits[s]
    for shard, _, ordinal, split, n_actions, following in rows:
        if limits is not None and all(full(s, t) for s in build.SPLITS for t in tasks):
            break
        if max_rows is not None and sum(n for (_, t), n in counts.items() if t == tasks[0]) >= max_rows:
            break
        processed += 1
        open_ = [t for t in tasks if split is not None and not full(split, t)]
        reason = "gameid_not_in_split" if split is None else "unmapped_raw_key_code" if n_actions is None else "ambiguous_raw_key_code" if n_actions > 1 else None
        if split is not None and not open_:
            skipped += 1
            continue
        if reason is None:
            for t in open_:
                if t == "next_frame" and following is None:
                    reason = "missing_next_observation"
                else:
                    counts[split, t] = counts.get((split, t), 0) + 1
                    kept.append((shard, ordinal, split, t))
        if reason is not None:
            rejected[reason] = rejected.get(reason, 0) + 1
    return {"processed": processed, "skipped": skipped, "accepted": counts, "rejected": rejected, "rows": sorted(kept)}


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    rng, rows = random.Random(2), []
    for shard in range(12):
        for k in range(60):
            split = rng.choice(["train"] * 6 + ["validation", "test", None])
            rows.append((shard, shard * 100 + k // 20, k, split, rng.choice([1, 1, 1, 1, 2, None]), rng.choice(["x", "y", None])))
    folder = str(tmp_path_factory.mktemp("shards") / "rows")
    spark.createDataFrame(rows, f"shard_index int, {SCHEMA}").repartition(3).write.partitionBy("shard_index").parquet(folder)
    return folder, rows


def scanned(spark, folder):
    return spark.read.schema(f"{SCHEMA}, shard_index int").parquet(folder)


CASES = [
    ({"train": 50, "validation": 8, "test": 8}, None, build.TASKS),
    ({"train": 200, "validation": 5, "test": 1}, None, ("next_frame",)),
    ({"train": 9000, "validation": 5, "test": 5}, None, build.TASKS),
    (None, 70, build.TASKS),
    (None, 35, ("next_frame",)),
    (None, None, build.TASKS),
]


@pytest.mark.parametrize(("limits", "max_rows", "tasks"), CASES)
def test_build_is_row_by_row(spark, shards, tmp_path, limits, max_rows, tasks):
    folder, rows = shards
    want = row_by_row(rows, limits, max_rows, tasks)
    scan, path = scanned(spark, folder), str(tmp_path)
    told = progressive.progressive_build(scan, path, shards=range(12), prepare=lambda x: x, tasks=tasks, limits=limits, max_rows=max_rows)
    sums = progressive.totals(told)
    assert {k: sums[k] for k in ("processed", "skipped", "accepted", "rejected")} == {k: want[k] for k in ("processed", "skipped", "accepted", "rejected")}
    kept = progressive.built(spark, path, f"{SCHEMA}, shard_index int, step int, task string")
    assert sorted(tuple(r) for r in kept.select("shard_index", "ordinal", "split", "task").collect()) == want["rows"]


def test_later_shards_are_never_opened(spark, shards, tmp_path):
    folder, rows = shards
    limits = {"train": 50, "validation": 8, "test": 8}
    last = max(shard for shard, *_ in row_by_row(rows, limits, None, build.TASKS)["rows"])
    copied = tmp_path / "shards"
    scanned(spark, folder).write.partitionBy("shard_index").parquet(str(copied))
    opened = next(n for n in (1, 3, 7) if n > last)
    assert opened < 12
    for shard in range(opened, 12):
        for file in Path(copied, f"shard_index={shard}").glob("*.parquet"):
            file.write_bytes(b"no parquet")
            Path(file.parent, f".{file.name}.crc").unlink(missing_ok=True)
    scan = scanned(spark, str(copied))
    with pytest.raises(Exception, match="(?i)parquet"):
        scan.agg(F.sum("ordinal")).collect()
    told = progressive.progressive_build(scan, str(tmp_path / "out"), shards=range(12), prepare=lambda x: x, limits=limits)
    assert told[-1]["done"] and progressive.totals(told)["shards"] == opened
    assert [r["shards"] for r in told] == list(progressive.widening(range(12)))[: len(told)]


def test_build_goes_on_after_a_kill(spark, shards, tmp_path):
    folder, _ = shards
    limits, scan = {"train": 150, "validation": 8, "test": 8}, scanned(spark, folder)
    whole = progressive.progressive_build(scan, str(tmp_path / "a"), shards=range(12), prepare=lambda x: x, limits=limits)
    calls = []

    def killed(rows):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return rows

    with pytest.raises(KeyboardInterrupt):
        progressive.progressive_build(scan, str(tmp_path / "b"), shards=range(12), prepare=killed, limits=limits)
    # what a killed step has left is overwritten
    scan.limit(5).withColumn("task", F.lit("next_frame")).write.partitionBy("split", "task").parquet(str(tmp_path / "b/rows/step=2"))
    seen = []
    again = progressive.progressive_build(scan, str(tmp_path / "b"), shards=range(12), prepare=lambda x: x, limits=limits, progress=seen.append)
    assert progressive.totals(again) == progressive.totals(whole) and [r["step"] for r in seen] == list(range(2, len(whole)))
    fields = f"{SCHEMA}, shard_index int, step int, task string"
    both = [sorted(map(repr, progressive.built(spark, str(tmp_path / p), fields).collect())) for p in "ab"]
    assert both[0] == both[1]
    with pytest.raises(ValueError, match="other shards"):
        progressive.progressive_build(scan, str(tmp_path / "b"), shards=range(5, 12), prepare=lambda x: x, limits=limits | {"train": 9000})
