"""Conversation repair, periodic runs and decontamination: against brute force, odd inputs, and queries as wholes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, queries, repair, runs

DATA = "/root/testdata/sf0.001"


# --- conversation repair ---


def cheapest_edits(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, edits) for rows of (fault, initial), by trying all edits; at most three turns put in at one place."""
    after = {"S": {"s": "B", "u": "U"}, "B": {"u": "U"}, "A": {"u": "U"}, "U": {"a": "A"}}
    turn = {"S": "U", "B": "U", "A": "U", "U": "A"}

    @lru_cache(maxsize=None)
    def best(i: int, state: str, put_in: int) -> tuple[int, str]:
        ways = [(0, "")] if i == len(rows) and state in "SA" else []
        if put_in < 3:
            c, a = best(i, turn[state], put_in + 1)
            ways.append((c + 5, "I" + a))
        if i < len(rows):
            fault, initial = rows[i]
            c, a = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                c, a = best(i + 1, turn[state], 0)
                ways.append((c + 1 + late, "R" + a))
                if initial in after[state]:
                    c, a = best(i + 1, after[state][initial], 0)
                    ways.append((c + late, "K" + a))
        return min(ways, default=(10**9, ""))

    for i in range(len(rows), 0, -50):  # keeps the recursion shallow
        for state in "SBUA":
            best(i, state, 0)
    return best(0, "S", 0)


def repaired_row(conv, rows: list[tuple]) -> dict:
    """The report of one conversation, from rows of (turn, role, text) before damage."""
    after = []
    for turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case:
            new = (turn, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)
            after += [new] * (2 if case == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in after:
        ink = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = cheapest_edits([(f, r[1][:1]) for f, r in zip(faults, after, strict=True)])
    out, at, want = [], 0, "user"
    for edit in audit:
        if edit == "K":
            out.append(after[at][1:])
        elif edit in "IR":
            out.append((want, after[at][2] if edit == "R" else ""))
        at += edit != "I"
        if edit != "D":
            want = "assistant" if out[-1][0][0] == "u" else "user"
    turns = [r[0] for r in after if r[0] is not None]
    initials = [r[1][:1] for r in after]
    return {
        "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def repair_report(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return [r.asDict() for r in repair.report(df, repair.faulty(repair.damaged(df))).collect()]


def by_conv(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return sorted((repaired_row(c, r) for c, r in out.items()), key=repr)


def test_search_is_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        codes = "".join(rng.choice("ssuuuuaaaaoxSUAO") for _ in range(rng.randrange(9)))
        rows = [("blank" if c == "x" else "truncated" if c.isupper() else "", c.lower()) for c in codes]
        assert repair.cheapest(codes, "S", "$") == cheapest_edits(rows)


def test_repairs_are_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.choice((1, 2, 5, 8, 20))):
            text = rng.choice(["Yes.", "No!", "  ", "", None, "Why? ", "and so", f"t{turn}.", "."])
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    assert sorted(repair_report(spark, rows), key=repr) == by_conv(rows)


def test_long_conversations_are_searched_in_segments(spark):
    rng = random.Random(9)
    rows = []
    for conv, n in ((1, 64), (2, 65), (3, 128), (4, 500), (5, 300)):
        for turn in range(n):
            role = "user" if conv == 5 else rng.choice(["user", "assistant"][turn % 2 :][:1] * 5 + ["user", "system"])
            rows.append((conv, turn, role, rng.choice([f"t{turn}.", f"t{turn}.", f"t{turn}", "same."])))
    # nothing is kept before the second segment
    rows += [(6, t, "system", " ") for t in range(70)] + [(6, 70, "system", "On."), (6, 71, "user", "So."), (6, 72, "assistant", "Yes.")]
    assert sorted(repair_report(spark, rows), key=repr) == by_conv(rows)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (1, 3, "user", "d.")], "conv_id long, turn long, role string, text string")
    found = [tuple(r) for r in repair.repaired(df).orderBy("edit_no").collect()]
    assert "".join(r[2] for r in found) == cheapest_edits([("", "u"), ("", "u"), ("", "a"), ("", "u")])[1] and [r[0] for r in found] == [1] * len(found)
    assert [r[4] for r in found if r[4]] == ["user", "assistant"] * (sum(r[4] is not None for r in found) // 2)


def test_repair_of_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(empty, repair.faulty(repair.damaged(empty))).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair_report(spark, [(dropped, 0, "user", "x" * 300_000)])
    assert row == {"conv_id": dropped, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    clash = spark.createDataFrame([(1, 5, "user", "Long. " * 50_000, 1, 2)], "conv_id long, turn long, role string, text string, pos int, fault int")
    assert repair.repaired(clash).count() == 2 or repair.repaired(clash).first().edit == "D"


# --- periodic runs ---


def all_runs(w: list) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted((s, n, q) for s, n, q in found)


def damaged_words(doc_id, words: list) -> list:
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def run_row(doc_id, text) -> tuple:
    words = damaged_words(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = all_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def random_words(rng) -> list[bytes]:
    out: list[bytes] = []
    for _ in range(rng.randrange(1, 6)):
        piece = [rng.choice((b"a", b"b", b"c", b"d")) for _ in range(rng.randrange(1, 30))]
        out += piece * rng.choice((1, 1, 2, 3, 5)) + piece[: rng.randrange(len(piece))]
    return out


def test_runs_are_brute_force():
    rng = random.Random(3)
    texts = [random_words(rng) for _ in range(300)] + [[], [b"a"], [b"a"] * 11, [b"a"] * 12, [b"a"] * 500, [b"a", b"b"] * 300, [b"a"] * 40 + [b"b"] + [b"a"] * 40]
    assert runs.runs(texts) == [all_runs(t) for t in texts]
    assert [f for _, f in runs.of_texts([b"\x0b ".join(t) for t in texts])] == [all_runs(t) for t in texts]
    assert runs.of_texts([None, b"", b" \n "]) == [([], []), ([], []), ([], [])]


def test_runs_of_very_long_texts():
    rng = random.Random(4)
    piece = [b"%d" % rng.randrange(50) for _ in range(30_000)]
    ((_, found),) = runs.of_texts([b" ".join(piece * 3)])
    assert (0, 90_000, 30_000) in found
    ((_, found),) = runs.of_texts([b"x " * 200_000])
    assert found == [(0, 200_000, 1)]


def test_runs_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {tuple(r) for r in queries.op12_periodic_runs(spark, DATA).collect()}
    assert found == {run_row(r.doc_id, r.text) for r in docs.collect()}


def test_runs_of_odd_tables(spark):
    ids = [None, 1, 1, *range(2, 40)]
    texts = [None if k == 5 else "" if k == 6 else " \x0b\n" if k == 7 else "one two three " * (k or 3) for k in ids]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int, n string")
    assert sorted(map(repr, map(tuple, runs.report(runs.damaged(df)).collect()))) == sorted(repr(run_row(i, t)) for i, t in zip(ids, texts, strict=True))
    assert runs.report(runs.damaged(df.filter("false"))).count() == 0
    kept = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in runs.collapsed(df.filter("doc_id = 39")).collect()}
    assert kept == {39: ("one two three", [(0, 117, 3)])}


# --- decontamination ---


def leak_words(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def leak_rows(docs, items, window: int = 10) -> list[tuple]:
    split = [(str(i) if i is not None else "", leak_words(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        words = leak_words(text)
        hit, ids = set(), set()
        for item, own in split:
            m = min(window, len(own))
            wins = {tuple(own[o : o + m]) for o in range(len(own) - m + 1)} if own else set()
            for p in range(len(words) - m + 1 if wins else 0):
                if tuple(words[p : p + m]) in wins:
                    hit |= set(range(p, p + m))
                    ids.add(item)
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_leaks_are_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["a", "b", "c", "Ä", "x9"]) for _ in range(n))
    items = [(k, say(rng.randrange(0, 14))) for k in range(30)] + [(None, "a, b. A B"), (3, "c c c"), (77, None), (78, say(60))]
    docs = [(k % 90, say(rng.randrange(0, 40))) for k in range(100)] + [(None, None), (-1, ""), (5, "..."), (6, f"A-{items[-1][1].upper()}"), (7, say(30_000))]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, matches int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    want = leak_rows(docs, items)
    for block_words, shard_bytes in ((2_000_000, 2**22), (20, 300)):
        found = decontaminate.report(decontaminate.located(df, bench, block_words=block_words, shard_bytes=shard_bytes)).drop("longest")
        assert sorted(map(tuple, found.collect()), key=repr) == want
    assert decontaminate.decontaminated(df, bench).count() == sum(not r[5] for r in want)
    assert decontaminate.located(df.filter("false"), bench).count() == 0
    assert decontaminate.located(df, bench.filter("false")).filter(F.size("matches") > 0).count() == 0


def test_longest_matches_have_their_places(spark):
    item = " ".join(f"w{k}" for k in range(40))
    text = "start " + " ".join(f"w{k}" for k in range(5, 30)) + " then " + item
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = decontaminate.located(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [tuple(m) for m in row.matches] == [("9", 1, 26, 5), ("9", 27, 67, 0)]


@pytest.mark.parametrize("depth", [1, 3, 10])
def test_suffixes_are_sorted(depth):
    import numpy as np

    rng = np.random.default_rng(1)
    hashes, text = rng.integers(1, 4, 300).astype(np.uint64), np.sort(rng.integers(0, 5, 300))
    words = [[int(h) for h in hashes[text == t]] for t in range(5)]
    first = np.cumsum([0, *map(len, words)])
    own = decontaminate.Suffixes(hashes, text, depth)
    listed = [words[text[k]][k - first[text[k]] :][:depth] for k in own.word[own.order].tolist()]
    assert listed == sorted(listed)
