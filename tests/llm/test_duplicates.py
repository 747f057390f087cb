"""Near-duplicates and line dedup against brute force, components against union-find, and odd inputs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import components, line_dedup, minhash, queries, shingles, words

SMALL = "/root/testdata/sf0.001"


def union_find(links, vertices):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


def shingle_words(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def near(texts, width):
    sets = {i: shingle_words(t, width) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, union_find(links, ids)


def corpus(seed=5, groups=8, copies=14):
    """Groups of near copies with 0 to 12 words changed, in chains and stars, among unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts, key = {}, 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((6, 40, 120)))]
        for c in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 10))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts[key] = " ".join(own)
            key += 1
            if c % 5 == 0:
                base = own
    for _ in range(60):
        texts[key] = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 50)))
        key += 1
    return texts


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_are_those_of_brute_force(spark, width):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets, want = near(texts, width)
    for r in minhash.near_duplicates(docs, width).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "A B C D"), (7, "A B C D"), (None, "a b c d"), (8, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit("clash"))
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 4).collect()), key=str)
    assert got == sorted([(-1, 1, 6, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 6, False), (8, 1, 8, True)], key=str) or got[0][0] == -1
    kept = minhash.deduplicated(docs, 4)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 8]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.deduplicated(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    want = union_find(links, {v for p in links for v in p})
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {v for a, b in links if a != b for v in (a, b)}
    assert got == {v: want[v] for v in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: int(0.8 * n)], rng.integers(0, 2**63, n - int(0.8 * n)).astype(np.uint64)])
        x, y = shingles.sketch(np.unique(a), 400), shingles.sketch(np.unique(b), 400)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (x != 0).all() and abs((x == y).mean() - true) < 0.12


def test_words_are_those_of_split():
    texts = [b"Ab ab\tAB\x0b\ncd", b"", None, b" lead", b"trail ", b"\n\n", "é  x".encode(), b"L" * 5000 + b" l", b"x\x1cy"]
    found = words.Words(texts)
    want = [(t, k, w) for t, b in enumerate(texts) for k, line in enumerate((b or b"").lower().split(b"\n")) for w in line.split()]
    assert list(zip(found.text.tolist(), found.line.tolist())) == [(t, k) for t, k, _ in want]
    by = {}
    for (_, _, w), h in zip(want, found.hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def removed(rows):
    """(doc_id, line) of the lines that go, by comparing all."""
    lines = [(i, k, frozenset(x.split())) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.encode().lower().split(b"\n"))]
    lines = [x for x in lines if x[2]]
    out = set()
    for i, k, w in lines:
        for j, m, v in lines:
            common = len(w & v)
            if (j, m) < (i, k) and 100 * common >= 80 * (len(w) + len(v) - common):
                out.add((i, k))
                break
    return out


def line_corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(60)] + ["the", "of"] * 5
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            own = list(rng.choice(bases)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
            for _ in range(rng.randint(0, 3)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text.append(" ".join(own))
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_lines_are_those_of_brute_force(spark, seed):
    rows = line_corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, k) for r in line_dedup.removed_lines(docs).collect() for k in r.removed}
    assert got == removed(rows)


def test_large_buckets_go_through_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_BLOCK", 10)
    monkeypatch.setattr(line_dedup, "_COMPARED", 4)
    rows = line_corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, k) for r in line_dedup.removed_lines(docs).collect() for k in r.removed} == removed(rows)


def line_links(rows):
    """doc_id -> its lines' matches among the different sets of all lines, earlier or later, by comparing all."""
    lines = [(i, frozenset(x.split())) for i, t in rows for x in t.encode().lower().split(b"\n") if x.split()]
    sets = {w for _, w in lines}
    degree = {w: sum(v != w and 100 * len(w & v) >= 80 * len(w | v) for v in sets) for w in sets}
    out = {}
    for i, w in lines:
        out[i] = out.get(i, 0) + degree[w]
    return out


@pytest.mark.parametrize("compared", [512, 4])
def test_links_are_those_of_brute_force(spark, monkeypatch, compared):
    """A chain and a dense group: links that come later, several earlier ones, and pairs beside a bucket's hub."""
    monkeypatch.setattr(line_dedup, "_COMPARED", compared)
    base = [f"b{k}" for k in range(20)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(12)] + [(100 + i, " ".join(f"c{k}" for k in range(i, i + 20))) for i in range(8)]
    rows += [(200 + i, t) for i, t in line_corpus(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in line_dedup.removed_lines(docs).collect()}
    assert got == line_links(rows) and got[0] == 11


def test_frequent_words_do_not_wrap_their_counter(spark):
    """One document of 2**16 + 1 lines with a word in common, which would be counted as in one line."""
    docs = spark.createDataFrame([(1, "\n".join(["same"] * (2**16 + 1)))], "doc_id long, text string")
    table = line_dedup._rarity(line_dedup._keyed(line_dedup._bodies(docs)).cache())
    assert table.max() >= int(2000 * np.log2(50_000)) and (table > 0).sum() == 1


def test_line_dedup_of_odd_rows(spark):
    rows = [(1, "a b c\nx", 5, "m"), (2, "C B A\nnew line here\n\n", 99, "n"), (3, None, None, None), (None, "a b c", 5, "o"), (4, "x", 1, "p"), (5, "", 0, "q"), (2, "C B A\nnew line here\n\n", 99, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, cut_lines string")
    out = line_dedup.deduplicated(docs)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    two = (2, "new line here\n\n", len("new line here\n\n"), "n")
    assert out.columns == docs.columns
    assert got == sorted([rows[0], two, two, rows[2], rows[3], rows[5]], key=str)
    assert line_dedup.deduplicated(docs, drop_emptied=False).count() == 7
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def thue_morse(n):
    """Two different words of 2**n letters that hashes by powers of an odd number, modulo 2**64, can't tell apart from n = 10 on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_a_known_pair_differ(spark):
    a, b = thue_morse(10)
    for fold in (False, True):
        found = words.Words([a.encode(), b.encode(), a.encode()], fold, checks=True)
        assert found.hashes[0] == found.hashes[2] != found.hashes[1] and found.checks[0] == found.checks[2] != found.checks[1]
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(docs).collect()} == {1: [], 2: [], 3: [0]}


@pytest.mark.parametrize("lines", [65_535, 65_536, 70_000])
def test_links_of_a_very_long_text(spark, lines):
    docs = spark.createDataFrame([(1, "\n".join(["pp qq rr ss"] * lines + ["pp qq rr ss tt"]))], "doc_id long, text string")
    (row,) = line_dedup.removed_lines(docs).collect()
    assert row.removed == list(range(1, lines + 1)) and (row.n_lines, row.n_links) == (lines + 1, lines + 1)


@pytest.mark.parametrize(("percent", "removed"), [(80, []), (76, []), (75, [0]), (70, [0])])
def test_small_sets_link_by_the_threshold(spark, percent, removed):
    docs = spark.createDataFrame([(1, "w x y"), (2, "w x y z")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(docs, percent).collect()} == {1: [], 2: removed}


def test_line_query_is_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, SMALL).collect()}
    gone, links, first, counted = removed(rows), line_links([(i, t or "") for i, t in rows]), {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        for x in (text or "").encode().lower().split(b"\n"):
            if x.split():
                first.setdefault(frozenset(x.split()), i)
                counted.setdefault(i, []).append(first[frozenset(x.split())])
    assert set(got) == {i for i, _ in rows}
    for i, r in got.items():
        own = [int(k) for k in r.removed.split(",") if k]
        assert own == sorted(k for j, k in gone if j == i)
        assert (r.n_removed, r.n_links, r.n_lines, r.class_id) == (len(own), links.get(i, 0), len(counted.get(i, [])), min(counted.get(i, [i])))


def test_near_duplicate_query_is_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sets, want = near(texts, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op4_minhash_near_dedup(spark, SMALL).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}


def test_texts_of_one_id_are_in_one_component(spark):
    rows = [(3, "a b c d e f"), (4, "q r s t u v"), (5, "a b c d e f"), (5, "q r s t u v"), (6, "x y z"), (6, "k l m"), (7, "k l m"), (2, "k l m n o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 4).collect())
    assert got == [(2, 2, True), (3, 3, True), (4, 3, False), (5, 3, False), (5, 3, False), (6, 6, True), (6, 6, True), (7, 6, False)]
    assert sorted(r.doc_id for r in minhash.deduplicated(docs, 4).collect()) == [2, 3, 6, 6]
