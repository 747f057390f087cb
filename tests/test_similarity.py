"""The similarity ratio against difflib, on random texts, edited ones and long ones."""

from __future__ import annotations

import random
import time
from difflib import SequenceMatcher

import pytest

from tests.conftest import SMALL
from tracemill.functions.similarity import ratio, similarity_ratio
from tracemill.plans import queries as plans

WIDE = "".join(map(chr, range(0x4E00, 0x5200)))


def edited(rng, text: str, letters: str, n: int) -> str:
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(3)] = rng.choice(letters) * rng.randrange(3)
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", WIDE, WIDE + "e" * 2000 + " " * 900])
def test_ratio_is_difflib(letters):
    rng = random.Random(len(letters))
    for _ in range(600):
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice((4, 60, 500)))))
        for b in (edited(rng, a, letters, rng.randrange(9)), "".join(rng.choice(letters) for _ in range(rng.randrange(400)))):
            assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_long_texts_take_their_length():
    rng = random.Random(6)
    took = {}
    for size in (25_000, 100_000):
        a = "".join(rng.choice(WIDE) for _ in range(size))
        b = edited(rng, a, WIDE, 40)
        began = time.time()
        found = ratio(a, b)
        took[size] = time.time() - began
        if size == 25_000:
            assert found == SequenceMatcher(None, a, b).ratio()
        assert 0.99 < found < 1
    assert took[100_000] < 12 * took[25_000] + 1
    assert ratio("ab" * 50_000, "ab" * 50_000) == 1.0 and ratio("x" * 100_000, "") == 0.0


def test_columns_with_nulls(spark):
    df = spark.createDataFrame([("a", "a"), (None, None), ("", "b"), (None, "b"), ("abcd", "bcde"), ("abcd", "bcde")], "a string, b string")
    assert [r[0] for r in df.select(similarity_ratio("a", "b")).collect()] == [1.0, 1.0, 0.0, 0.0, 0.75, 0.75]


def test_turns_are_compared_whole(spark):
    rows = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    got = plans.QUERIES["turn_similarity"](spark, SMALL).collect()
    assert len(got) == sum((c, t + 1) in rows for c, t in rows)
    for r in got:
        assert r.similarity == pytest.approx(SequenceMatcher(None, rows[r.conv_id, r.turn], rows[r.conv_id, r.turn + 1]).ratio(), abs=1e-6)
