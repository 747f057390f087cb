"""Scalar and frame functions on small literals."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from tracemill.functions import events, frames, scalars, udfs

FRAME = "MAP:\n@.\nMESSAGE:\nReady\nBLSTATS:\n[0]\nINVENTORY:\n<empty>"


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).head()


def test_ratios(spark):
    r = one(spark, a=scalars.rate(F.lit(1), F.lit(0)), b=scalars.rate_or_null(F.lit(1), F.lit(0)), c=scalars.difference(F.lit(None), F.lit(2)), d=scalars.rate(F.lit(1), F.lit(4)))
    assert (r.a, r.b, r.c, r.d) == (0.0, None, 0.0, 0.25)


def test_small_scalars(spark):
    r = one(
        spark,
        log=scalars.signed_log1p(F.lit(-2.0)), keep=scalars.missing_as(F.lit(""), "unknown"), label=scalars.key_label(F.lit(107)), code=scalars.key_label(F.lit(7)),
        depth=scalars.depth_bucket(F.lit("5")), odd=scalars.depth_bucket(F.lit("x")), ints=scalars.int_list(F.lit("1, 2,,x")), text=scalars.list_text(F.array(F.lit(1), F.lit(2))), action=scalars.action_text(F.lit(3)),
    )
    assert abs(r["log"] + 1.0986122886681098) < 1e-12
    assert (r.keep, r.label, r.code, r.depth, r.odd) == ("unknown", "k", "keycode_7", "4-6", "unknown")
    assert (r.ints, r.text, r.action) == ([1, 2, None], "[1, 2]", '{"action_id": 3}')


def test_bucket_is_the_sha256_prefix(spark):
    import hashlib

    r = one(spark, b=scalars.hash_bucket(7, F.lit(12)))
    assert r.b == int(hashlib.sha256(b"7:12").hexdigest()[:8], 16) / 0xFFFFFFFF


def test_frame_text(spark):
    observation = "struct<tty_chars: array<array<int>>, message: array<int>, blstats: array<int>, inventory: array<int>>"
    rows = spark.createDataFrame([(([[64, 46, 0], [0, 0, 0], [35, 0, 0]], [82, 101, 0, 97, 100, 121, 32], [1, 2], []),), (([], [], [], None),)], f"o {observation}")
    full, empty = (r.t for r in rows.select(frames.frame_text(F.col("o")).alias("t")).collect())
    assert full == "MAP:\n@.\n\n#\nMESSAGE:\nReady\nBLSTATS:\n[1, 2]\nINVENTORY:\n<empty>"
    assert empty == "MAP:\n<missing>\nMESSAGE:\n<missing>\nBLSTATS:\n<missing>\nINVENTORY:\n<missing>"
    assert rows.select(frames.frame_text(F.col("o"), compact=True).alias("t")).head().t.startswith("MAP:\n@.\n#\nMESSAGE:")


def test_sections(spark):
    text = F.lit(FRAME)
    r = one(
        spark, m=frames.section(text, "MAP:"), s=frames.section(text, "MESSAGE:"), none=frames.section(text, "OTHER:"), cells=frames.map_cells(text), at=frames.player_position(frames.map_cells(text)),
        b=frames.blstats_values(text), lit=frames.blstats_values(F.lit("BLSTATS:\n[1, 'a', None]")), t=frames.tolerant_section(F.lit(" MAP: \n@\nODD:\nx\nMESSAGE:\nhi"), "MAP"),
    )
    assert (r.m, r.s, r.none) == ("@.", "Ready", "")
    assert [tuple(c) for c in r.cells] == [(0, 0, "@"), (0, 1, ".")] and tuple(r["at"]) == (0, 0)
    assert (r.b, r["lit"], r.t) == (["0"], ["1", "a", None], "@\nODD:\nx")


def test_markers_first_and_last(spark):
    text = F.lit("a Current observation:\nb Current observation:\nc\n")
    r = one(spark, last=frames.after_last_marker(text), first=frames.after_first_marker(text), none=frames.after_first_marker(F.lit("x")))
    assert (r["last"], r["first"], r["none"]) == ("c\n", "b Current observation:\nc", None)


def test_responses(spark):
    texts = ["MAP:\n@", '{"next_frame": "x"}', '{"next_frame": 1}', '{"other": "x"}', '{"next_frame": "x', "no"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", frames.parsed_response(F.col("t")).alias("p")).select("p.*", frames.parse_failure(F.col("t"), F.col("p.error")).alias("why")).collect()
    assert [r.frame for r in rows] == ["MAP:\n@", "x", None, None, None, None]
    assert [r.why for r in rows] == [None, None, "wrong_value_type", "wrong_schema", "truncated_json", "invalid_json"]


def test_validation(spark):
    frame = "MAP:\n@\nMESSAGE:\nm\nBLSTATS:\n[" + ", ".join("1" * 27) + "]\nINVENTORY:\n[]"
    r = one(spark, v=frames.frame_validation(F.lit(frame), F.lit(frame.replace("m\n", "n\n"))), w=frames.frame_validation(F.lit("MAP:\n.")))
    assert r.v.observation_shape_valid and r.v.map_exact_match and not r.v.message_exact_match and not r.v.ground_truth_exact_match
    assert r.w.missing_sections == ["MESSAGE", "BLSTATS", "INVENTORY"] and not r.w.observation_shape_valid


def test_characters(spark):
    r = one(spark, a=frames.char_accuracy(F.lit("abc"), F.lit("axcd")), b=frames.char_accuracy(F.lit(""), F.lit("")), lines=frames.lines(F.lit("a\r\nb\n\nc\n")))
    assert (r.a, r.b, r.lines) == (0.5, 1.0, ["a", "b", "", "c"])


def test_events(spark):
    base = dict(message="", hunger=None, death=None, terminal_frame=None, menu_open=None, game_time_advanced=None)
    told = [base | {"message": "A WALL"}, base | {"message": "Really quit?"}, base | {"hunger": "Not hungry"}, base | {"hunger": "Hungry"}, base | {"message": "You can't move"}, base | {"menu_open": True}, base | {"game_time_advanced": False}, base | {"death": "fainted"}]
    rows = spark.createDataFrame([Row(**t) for t in told], "message string, hunger string, death string, terminal_frame string, menu_open boolean, game_time_advanced boolean")
    got = rows.select(events.is_wall().alias("w"), events.is_prompt().alias("p"), events.is_bad().alias("b"), events.is_hunger_warning().alias("h"), events.is_starving().alias("s"), events.is_dirty().alias("d")).collect()
    flags = ["".join(k for k in "wpbhsd" if r[k]) for r in got]
    assert flags == ["wbd", "pbd", "", "h", "bd", "pbd", "d", "sd"]


def test_map_tiles(spark):
    frame = "MAP:\n|..@\nab\n...x\n.....xyz..\nMESSAGE:\n@@@"
    tiles = one(spark, t=events.map_tiles(F.lit(frame))).t
    assert tiles == ["0:0:|", "0:1:.", "0:2:.", "0:3:@", "2:0:.", "2:1:.", "2:2:."] + [f"3:{k}:." for k in (0, 1, 2, 3, 4, 8, 9)]


def test_recording(spark):
    data = one(spark, r=udfs.terminal_recording(F.array(F.lit("a\nb"), F.lit("c")), F.lit(1.25))).r
    payload = b"\x1b[2J\x1b[Ha\r\nb\r\n"
    assert data[:12] == (0).to_bytes(4, "little") * 2 + len(payload).to_bytes(4, "little") and data[12 : 12 + len(payload)] == payload
    assert data[12 + len(payload) :][:8] == (1).to_bytes(4, "little") + (250000).to_bytes(4, "little")


def test_scores(spark):
    rows = udfs.with_scores(spark.range(3), lambda batch: batch["id"] * 2.0, "score")
    assert [r.score for r in rows.orderBy("id").collect()] == [0.0, 2.0, 4.0]
