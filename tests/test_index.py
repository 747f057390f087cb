"""SQLite index files: columns, balanced ranges, filters run by the files, and consistent subsets."""

from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracemill.sources import index, readers


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Two index files with gaps between rowids, and what they hold."""
    folder, rng = tmp_path_factory.mktemp("index"), random.Random(3)
    games, recordings = [], []
    for k in range(2):
        with sqlite3.connect(folder / f"part-{k}.db") as db:
            db.execute("CREATE TABLE roots (dataset_name TEXT, root TEXT, ttyrec_version INTEGER)")
            db.execute("CREATE TABLE games (gameid INTEGER PRIMARY KEY, role TEXT, points INTEGER, rate REAL, mark BLOB)")
            db.execute("CREATE TABLE ttyrecs (path TEXT, part INTEGER, size INTEGER, mtime REAL, gameid INTEGER)")
            db.execute("INSERT INTO roots VALUES ('d', '/r', 3)")
            for g in range(300):
                gameid = k * 100_000 + g * g
                games.append((gameid, rng.choice(["Val", "Wiz", None]), rng.choice([None, g]), g / 4, b"\0m"))
                for part in range(rng.randrange(3)):
                    recordings.append((f"p{rng.randrange(20)}/{gameid}-{part}.bz2", part, g, 1.5, gameid))
            db.executemany("INSERT INTO games VALUES (?, ?, ?, ?, ?)", games[-300:])
            db.executemany("INSERT INTO ttyrecs VALUES (?, ?, ?, ?, ?)", [r for r in recordings if (r[4] >= 100_000) == bool(k)])
        db.close()
    return str(folder), games, recordings


def rows(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=repr)


def test_tables_and_ranges(spark, made):
    folder, games, recordings = made
    df = index.index_table(spark, folder, "games", rows=50)
    assert df.dtypes == [("gameid", "bigint"), ("role", "string"), ("points", "bigint"), ("rate", "double"), ("mark", "binary")]
    assert rows(df) == sorted(games, key=repr) and rows(index.index_table(spark, f"{folder}/part-1.db", "ttyrecs")) == sorted((r for r in recordings if r[4] >= 100_000), key=repr)
    sizes = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert df.rdd.getNumPartitions() == 12 and set(sizes) == {50}
    assert index.index_tables(folder)["roots"] == [("dataset_name", "TEXT"), ("root", "TEXT"), ("ttyrec_version", "INTEGER")]
    assert rows(df.select("points").filter("role IS NULL")) == sorted(((g[2],) for g in games if g[1] is None), key=repr)


@pytest.mark.parametrize(
    ("text", "keep"),
    [
        ("gameid = 49", lambda g: g[0] == 49), ("gameid > 100000 AND points <= 20", lambda g: g[0] > 100_000 and g[2] is not None and g[2] <= 20), ("role IN ('Val', 'x')", lambda g: g[1] == "Val"), ("role LIKE 'V%'", lambda g: g[1] == "Val"),
        ("points IS NULL", lambda g: g[2] is None), ("rate >= 70.5", lambda g: g[3] >= 70.5), ("points IS NOT NULL AND rate < 1", lambda g: g[2] is not None and g[3] < 1), ("role != 'Val'", lambda g: g[1] == "Wiz"),
    ],
)
def test_filters_are_run_by_the_files(spark, made, text, keep):
    folder, games, _ = made
    df = index.index_table(spark, folder, "games", rows=50).filter(text)
    assert rows(df) == sorted(filter(keep, games), key=repr)
    if "!=" not in text:  # left to Spark
        assert df.rdd.getNumPartitions() <= 2 + len(list(filter(keep, games))) // 50


def test_values_of_other_types(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (n INTEGER, s TEXT, r REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(1, "a", 1.0), ("x", b"b", "y"), (None, None, 2)])
    db.close()
    df = index.index_table(spark, str(tmp_path), "t")
    assert rows(df) == sorted([(1, "a", 1.0), (None, None, None), (None, None, 2.0)], key=repr)
    assert rows(df.filter("n IS NULL AND r IS NOT NULL")) == [(None, None, 2.0)]
    with sqlite3.connect(tmp_path / "b.db") as db:
        db.execute("CREATE TABLE t (other INTEGER)")
    db.close()
    with pytest.raises(Exception, match="other columns"):
        index.index_table(spark, str(tmp_path), "t").count()
    with pytest.raises(Exception, match="no index file"):
        index.index_table(spark, str(tmp_path), "none").count()


def test_subset_is_consistent(spark, made, tmp_path):
    folder, games, recordings = made
    chosen = spark.createDataFrame([("p3",), ("p7",), ("nobody",), ("p3",)], "player string")
    roots, kept, own = index.index_subset(spark, folder, chosen)
    want = [r for r in recordings if r[0].split("/")[0] in ("p3", "p7")]
    assert rows(own) == sorted(want, key=repr)
    assert rows(kept) == sorted((g for g in games if g[0] in {r[4] for r in want}), key=repr)
    assert rows(roots) == [("d", "/r", 3)]
    joined = readers.player_subset(spark.createDataFrame(recordings, "path string, part long, size long, mtime double, gameid long"), spark.createDataFrame(games, "gameid long, role string, points long, rate double, mark binary"), chosen)
    assert rows(own) == rows(joined[0].drop("player")) and rows(kept) == rows(joined[1])
    out = str(tmp_path / "subset")
    told = index.write_index(roots, kept, own, out, shards=4).collect()
    assert sum(r.recordings for r in told) == len(want) and {r.shard for r in told} <= set(range(4))
    for table, df in (("games", kept), ("ttyrecs", own)):
        assert rows(index.index_table(spark, out, table)) == rows(df)
    # games and their recordings are in one file
    for r in told:
        with sqlite3.connect(f"{out}/index-{r.shard}.db") as db:
            assert db.execute("SELECT count(*) FROM ttyrecs WHERE gameid NOT IN (SELECT gameid FROM games)").fetchone() == (0,)
            assert db.execute("SELECT count(*) FROM roots").fetchone() == (1,)
        db.close()
    none = index.index_subset(spark, folder, chosen.filter("player = 'nobody'"))
    assert [df.count() for df in none] == [0, 0, 0]


def test_shards_are_written_batch_by_batch(spark, tmp_path):
    large = (1 << 60) + 1
    games = spark.createDataFrame([(g, "Val" if g % 2 else None) for g in range(500)], "gameid long, role string")
    recordings = spark.createDataFrame([(f"p/{g}", None if g % 7 else large, 500 - g) for g in range(500)], "path string, part long, gameid long")
    roots = spark.createDataFrame([("d", "/r", 3)], "dataset_name string, root string, ttyrec_version long")
    out, before = str(tmp_path / "out"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        made = index.write_index(roots, games, recordings, out, shards=3)
        assert "Pandas" not in made._jdf.queryExecution().toString()  # no group is held whole
        told = {r.shard: (r.games, r.recordings) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(told) == {0, 1, 2} and tuple(map(sum, zip(*told.values(), strict=True))) == (500, 500)
    # whole numbers stay whole beside nulls
    for table, df in (("games", games), ("ttyrecs", recordings)):
        assert rows(index.index_table(spark, out, table, rows=60)) == rows(df)
    for shard, (n, _) in told.items():
        with sqlite3.connect(f"{out}/index-{shard}.db") as db:
            ids = [g for (g,) in db.execute("SELECT gameid FROM games ORDER BY rowid")]
            assert ids == sorted(ids) and len(ids) == n
        db.close()


def test_joins_of_a_subset_are_not_merged_into_few_parts(spark):
    from tracemill.operators import splits

    recordings = spark.range(2000).select(F.concat(F.lit("p"), F.col("id") % 5, F.lit("/"), "id").alias("path"), (F.col("id") % 400).alias("gameid"))
    games, chosen = spark.range(400).select(F.col("id").alias("gameid")), spark.createDataFrame([("p1",), ("p2",)], "player string")
    own, kept = readers.player_subset(recordings, games, chosen)
    met = own.join(kept, "gameid")
    assert (met.count(), kept.count()) == (800, 160)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = own.join(kept, "gameid")
        assert met.count() == 800 and met.rdd.getNumPartitions() == splits.range_count(games) == 64
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
