"""Reports of mixed shapes in one column."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracemill.sources import shapes

WHOLE = {"name": "r", "rows": {"train": 5, "test": [1, {"x": None}]}, "ok": True, "rate": 0.5}
TEXTS = {"whole": json.dumps(WHOLE), "torn": json.dumps(WHOLE)[:-3], "blank": "  ", "none": None, "list": "[1, 2]", "text": '"rows"', "null": "null", "odd": '{"name": 3, "rows": [], "ok": null}', "empty": "{}", "deep": '{"name": "d", "rows": {"train": "5"}, "ok": "true", "rate": 1e400}'}


@pytest.fixture(scope="module")
def reports(spark):
    return shapes.parsed(spark.createDataFrame(list(TEXTS.items()), "id string, text string"), "text")


def test_parts_of_other_shapes_have_rows(reports):
    required = {"$.name": "string", "$.rows.train": "number", "$.ok": "boolean", "$.rows.test[1].x": "null"}
    got = {}
    for r in shapes.problems(reports, required, key="id").collect():
        got.setdefault(r.id, {})[r.path] = (r.problem, r.found)
    assert "whole" not in got
    assert got["blank"] == got["none"] == got["torn"] == {"$": ("malformed", None)}
    assert got["list"] == {"$": ("not_an_object", "array")} and got["text"] == {"$": ("not_an_object", "string")} and got["null"] == {"$": ("not_an_object", "null")}
    assert got["empty"] == {p: ("missing", None) for p in required}
    assert got["odd"] == {"$.name": ("wrong_kind", "number"), "$.rows.train": ("missing", None), "$.ok": ("wrong_kind", "null"), "$.rows.test[1].x": ("missing", None)}
    if "deep" in got and "$" not in got["deep"]:  # numbers beyond a double may count as malformed
        assert got["deep"] == {"$.rows.train": ("wrong_kind", "string"), "$.ok": ("wrong_kind", "string"), "$.rows.test[1].x": ("missing", None)}
    with pytest.raises(ValueError, match="unknown kinds"):
        shapes.problems(reports, {"$.a": "text"}, key="id")


def test_look_ups(reports):
    rows = reports.select("id", shapes.nested(F.col("report"), "$.rows.train", "number", "long").alias("n"), shapes.nested(F.col("report"), "$.name", "string", "string").alias("name"))
    got = {r.id: (r.n, r.name) for r in rows.collect()}
    assert got["whole"] == (5, "r") and all(got[k] == (None, None) for k in ("torn", "blank", "none", "list", "text", "null", "odd", "empty"))


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(WHOLE, indent=2))
    (tmp_path / "b.json").write_text('{"name": ')
    got = {r.path.rsplit("/", 1)[1]: r.name for r in shapes.read_reports(spark, str(tmp_path / "*.json")).select("path", shapes.nested(F.col("report"), "$.name", "string", "string").alias("name")).collect()}
    assert got == {"a.json": "r", "b.json": None}
