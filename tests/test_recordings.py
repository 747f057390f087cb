"""Recordings: round trip, filters that choose files and bound their reading, torn and foreign files."""

from __future__ import annotations

from pathlib import Path

import pytest

from tracemill.sources import recordings


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(g, k, None if (g, k) == (3, 1) else f"game {g}\nstep {k} é\n\n") for g in range(8) for k in range(g * 100 if g == 7 else g)]
    df = spark.createDataFrame(rows, "gameid long, step int, frame string").repartition(4)
    path = str(tmp_path / "made")
    sizes = {r.gameid: r.bytes for r in recordings.write_recordings(df, path).collect()}
    assert {int(p.stem): p.stat().st_size for p in Path(path).iterdir() if not p.name.startswith(".")} == sizes
    return path, [(g, k, k * 0.25, t or "") for g, k, t in rows]


def read(df):
    return sorted(tuple(r) for r in df.collect())


def test_round_trip(spark, folder):
    path, rows = folder
    frames = recordings.recordings(spark, path)
    assert read(frames) == rows and frames.rdd.getNumPartitions() == 7
    assert recordings.recordings(spark, path, together=3).rdd.getNumPartitions() == 3
    assert read(recordings.recordings(spark, path, frames=2)) == [r for r in rows if r[1] < 2]
    assert read(recordings.recordings(spark, f"file://{path}", frames=0)) == []
    assert read(recordings.recordings(spark, path + "-none")) == []


@pytest.mark.parametrize(("filters", "games"), [("gameid IN (2, 5)", {2, 5}), ("gameid = 4", {4}), ("gameid > 2 AND gameid <= 4", {3, 4}), ("gameid IN (2, 5) AND gameid < 5", {2}), ("gameid = 99", set())])
def test_other_recordings_stay_unopened(spark, folder, filters, games):
    path, rows = folder
    for g in set(range(1, 8)) - games:
        Path(path, f"{g}.rec").unlink()
        Path(path, f"{g}.rec").mkdir()  # opening it is an error
    found = recordings.recordings(spark, path).filter(filters)
    assert read(found) == [r for r in rows if r[0] in games] and found.rdd.getNumPartitions() == max(1, len(games))


@pytest.mark.parametrize(("filters", "most"), [("step < 3", 3), ("step <= 1", 2), ("step = 2", 3), ("step < 0", 0)])
def test_nothing_behind_the_prefix_is_read(spark, folder, filters, most):
    path, rows = folder
    whole = Path(path, "7.rec").read_bytes()
    at = 0
    for _ in range(most):
        at += 12 + int.from_bytes(whole[at + 8 : at + 12], "little")
    Path(path, "7.rec").write_bytes(whole[:at] + (15).to_bytes(4, "little") * 3 + b"no frame at all")
    frames = recordings.recordings(spark, path)
    with pytest.raises(Exception, match="no recording"):
        frames.count()
    ends = {"step = 2": lambda k: k == 2}.get(filters, lambda k: k < most)
    assert read(frames.filter(filters)) == [r for r in rows if ends(r[1])]


def test_odd_files(spark, tmp_path):
    path = str(tmp_path / "odd")
    df = spark.createDataFrame([(-1, 0, "a"), (-1, 1, "b"), (2, 0, "")], "gameid long, step int, frame string")
    recordings.write_recordings(df, path).count()
    whole = Path(path, "-1.rec").read_bytes()
    Path(path, "-1.rec").write_bytes(whole[:-1])  # cut off within the second frame
    Path(path, "3.rec").write_bytes(b"")
    Path(path, "notes.txt").write_text("no recording")
    assert read(recordings.recordings(spark, path)) == [(-1, 0, 0.0, "a"), (2, 0, 0.0, "")]
    recordings.write_recordings(df, path).count()  # written again over what is there
    assert read(recordings.recordings(spark, path).filter("gameid < 0")) == [(-1, 0, 0.0, "a"), (-1, 1, 0.25, "b")]
    assert recordings.write_recordings(df.filter("false"), path).count() == 0


def test_chosen_games_alone_are_opened(spark, folder):
    path, rows = folder
    for g in (1, 4):
        Path(path, f"{g}.rec").unlink()
    games = spark.createDataFrame([(2,), (7,), (2,), (None,)], "gameid long")
    assert read(recordings.decoded_games(games, path)) == [r for r in rows if r[0] in (2, 7)]
    assert read(recordings.decoded_games(games, path, frames=5)) == [r for r in rows if r[0] in (2, 7) and r[1] < 5]
