"""Hot keys: salted joins, lines of hot classes and buckets dealt by size, with bounds low enough to be reached, against the plain results."""

from __future__ import annotations

import os
import random
import time

import pytest

from tracemill.llm import common, line_dedup, minhash
from .test_duplicates import line_corpus, line_links, near, removed


@pytest.fixture
def low_bounds(monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 20)


def test_salted_join_is_the_join(spark, low_bounds):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(2, 40), k) for k in range(400)] + [(None, 7)]
    frame = spark.createDataFrame(rows, "a long, b long")
    side = spark.createDataFrame([(k, f"s{k}") for k in range(30)], "a long, name string")
    hot = common.hot_keys(frame, "a")
    assert set(hot) == {1} and hot[1] > 5
    joined = common.salted_join(frame, side, "a", "b", hot)
    assert joined.columns == ["a", "b", "name"]
    assert sorted(joined.collect()) == sorted(frame.join(side, "a").collect()) and joined.count() > 300
    assert common.hot_keys(frame.limit(0), "a") == {}
    assert common.salted_join(frame.limit(0), side, "a", "b", hot).count() == 0


def test_few_keys_are_hot(spark, low_bounds):
    frame = spark.createDataFrame([(k % 7, k) for k in range(700)], "a long, b long")
    assert set(common.hot_keys(frame, "a")) == set(range(7))
    assert common.hot_keys(spark.createDataFrame([(k % 50, k) for k in range(700)], "a long, b long"), "a") == {}


@pytest.mark.parametrize("percent", [80, 50])
def test_parts_meet_where_sizes_can_match(spark, monkeypatch, percent):
    """Each pair of sets of a bucket that are near enough in size meets in just one pair of parts; sets far apart mostly don't."""
    monkeypatch.setattr(line_dedup, "_COMPARED", 4)
    monkeypatch.setattr(line_dedup, "_ELEMENTS", 64)
    rng = random.Random(2)
    sizes = {k: 10 if k < 40 else rng.randrange(4, 200) for k in range(120)}
    large = spark.createDataFrame([(w, k) for k in sizes for w in (1, 2) if w == 1 or k % 3 == 0], "word long, class long")
    lines = spark.createDataFrame([(k, k, 0) for k in sizes], "id long, doc_id long, line int")
    sets = spark.createDataFrame([(k, list(range(n))) for k, n in sizes.items()], "id long, elements array<long>")
    parts = {}
    for r in line_dedup._split(large, lines, sets, 4, percent).collect():
        side = parts.setdefault((r.word, r.p, r.q), ([], []))[int(r.second)]
        assert r["class"] not in side
        side.append(r["class"])
    met = {}
    for (word, p, q), (first, second) in parts.items():
        assert p < q or not second
        pairs = [(a, b) for a in first for b in (second if p < q else first) if p < q or a < b]
        for a, b in pairs:
            key = word, min(a, b), max(a, b)
            met[key] = met.get(key, 0) + 1
    assert set(met.values()) == {1}
    for word in (1, 2):
        own = [k for k in sizes if word == 1 or k % 3 == 0]
        fit = {(word, a, b) for a in own for b in own if a < b and 100 * min(sizes[a], sizes[b]) >= percent * max(sizes[a], sizes[b])}
        assert fit <= set(met)
    assert len(met) < 0.8 * (120 * 119 / 2 + 40 * 39 / 2)
    # the 40 sets of one size are dealt into parts
    assert len({p for (word, p, q), (first, _) in parts.items() if word == 1 and any(k < 40 for k in first)}) > 5


@pytest.mark.parametrize("compared", [512, 4])
def test_lines_of_hot_classes(spark, monkeypatch, low_bounds, compared):
    """One line in every document, a dense group of near copies, and no table that fits a broadcast."""
    monkeypatch.setattr(common, "fits", lambda df, rows=0, size=0: False)
    monkeypatch.setattr(line_dedup, "_COMPARED", compared)
    base = [f"b{k}" for k in range(20)]
    rows = [(i, (t + "\n" if t else "") + "all rights reserved") for i, t in line_corpus(5)]
    rows += [(100 + i, " ".join([*base, f"x{i}"]) + "\nall rights reserved") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.removed_lines(docs).collect()
    assert {(r.doc_id, k) for r in got for k in r.removed} == removed(rows)
    assert {r.doc_id: r.n_links for r in got} == line_links(rows)
    assert len(got) == len(rows)


def test_near_copies_of_a_hub(spark, monkeypatch, low_bounds):
    """A large group of near copies hangs on one hub, whose pairs are dealt over several tasks."""
    monkeypatch.setattr(common, "fits", lambda df, rows=0, size=0: False)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    texts = {i: " ".join([*base, f"end{i}"]) for i in range(40)}
    texts |= {100 + i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 12))) for i in range(60)}
    sets, want = near(texts, 4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}
    assert [i for i in range(40) if want[i] == 0] == list(range(40))


def unlike_lines(seed, n):
    """Lines of a few words from a small vocabulary: words are in many lines, and few lines match."""
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(60)]
    return [(i, " ".join(rng.sample(vocabulary, rng.randrange(8, 30)))) for i in range(n)]


def test_buckets_of_unlike_sets_are_not_split(spark, monkeypatch):
    """A bucket with many classes and few pairs lists its pairs; its sets aren't copied to parts. One of near copies gives back those that are in pairs."""
    monkeypatch.setattr(line_dedup, "_COMPARED", 16)
    base = [f"n{k}" for k in range(20)]
    rows = unlike_lines(7, 400)
    bodies = line_dedup._bodies(spark.createDataFrame(rows, "doc_id long, text string"))
    met = lambda b: line_dedup._met(line_dedup._prefixes(b, line_dedup._rarity(line_dedup._keyed(b).cache()), 80).repartition(4, "word").sortWithinPartitions("word"), 80)
    sizes = line_dedup._prefixes(bodies, line_dedup._rarity(line_dedup._keyed(bodies).cache()), 80).groupBy("word").count()
    assert sizes.filter("count > 16").count() > 10
    assert met(bodies).filter("b IS NULL").count() == 0
    near_copies = [(1000 + i, " ".join([*base, f"x{i}"])) for i in range(40)]
    both = line_dedup._bodies(spark.createDataFrame(rows + near_copies, "doc_id long, text string"))
    large = {(r.word, r.a) for r in met(both).filter("b IS NULL").collect()}
    assert large and len({c for _, c in large}) == 40


@pytest.mark.parametrize("compared, block", [(16, 50_000), (512, 40), (2, 50_000)])
def test_lines_of_frequent_words(spark, monkeypatch, compared, block):
    monkeypatch.setattr(line_dedup, "_COMPARED", compared)
    monkeypatch.setattr(line_dedup, "_BLOCK", block)
    base = [f"n{k}" for k in range(20)]
    rows = unlike_lines(8, 250) + [(1000 + i, " ".join([*base, f"x{i}"])) for i in range(30)]
    rows += [(2000 + i, t.replace("v1 ", "") + f" v{i % 60}") for i, t in rows[:80]]
    got = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, k) for r in got for k in r.removed} == removed(rows)
    assert {r.doc_id: r.n_links for r in got} == line_links(rows)


def test_shuffle_files_go_with_their_write(spark):
    """Spark removes the shuffle files of the write; the setting is as before afterwards, and what is read back stays."""
    before = spark.conf.get(common.CLEANUP)
    left = lambda: sum(name.startswith("shuffle_") for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(d) for name in names)
    was = left()
    out = common.written_clean(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "clean")
    for _ in range(50):
        if left() <= was:
            break
        time.sleep(0.1)
    assert left() <= was and spark.conf.get(common.CLEANUP) == before and out.count() == 7
