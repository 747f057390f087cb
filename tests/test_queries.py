"""Every registered query with SQL gives the rows that DuckDB gives, and has the same columns."""

import pytest

import __spark_entry__ as entry
from tracemill.plans import queries as plans

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert same_rows(plans.QUERIES[name](spark, SMALL).toPandas(), duck.sql(plans.ORACLES[name]).df())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(plans.ORACLES) <= set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_message_similarity_is_difflib(spark):
    from difflib import SequenceMatcher

    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect()
    first = {(r["conv_id"], r["turn"]): (r["text"] or "").split("\n")[0] for r in rows}
    got = plans.QUERIES["message_similarity"](spark, SMALL).collect()
    assert got
    for r in got:
        a, b = first[r["conv_id"], r["turn"]], first[r["conv_id"], r["turn"] + 1]
        assert r["similarity"] == pytest.approx(SequenceMatcher(None, a, b).ratio(), abs=1e-6)


def test_whole_sequences_are_compared(spark, tmp_path):
    from itertools import combinations

    import duckdb

    folder = str(tmp_path)
    # equal for 20 steps and different later, and one that is shorter
    lengths = {1: 25, 2: 25, 3: 25, 4: 22, 5: 3}
    kinds = ("click", "view", "error", "purchase", "signup")
    rows = [(user, k, kinds[(k + (user == 2 and k > 21)) % 5]) for user, n in lengths.items() for k in range(n)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE given AS SELECT * FROM (VALUES " + ", ".join(f"({u}, {k}, '{e}')" for u, k, e in rows) + ") v(u, k, e)")
    duck.execute(
        f"""COPY (SELECT e.* REPLACE (g.u * 100 + g.k AS event_id, g.u AS user_id, g.e AS event_type)
        FROM given g CROSS JOIN (SELECT * FROM '{SMALL}/events.parquet' ORDER BY event_id LIMIT 1) e) TO '{folder}/events.parquet' (FORMAT parquet)"""
    )
    steps = plans.tables.event_steps(spark, folder).orderBy("user_id", "step").collect()
    of = {u: [r["action_id"] for r in steps if r["user_id"] == u] for u in lengths}
    assert {u: len(a) for u, a in of.items()} == lengths
    pairs = list(combinations(of.values(), 2))
    share = [sum(x == y for x, y in zip(a, b)) / max(len(a), len(b)) for a, b in pairs]
    got = plans.QUERIES["whole_sequence_similarity"](spark, folder).head()
    assert plans.QUERIES["sequence_similarity"](spark, folder).head() == got
    assert (got.pair_count, got.equal_pairs) == (len(pairs), sum(a == b for a, b in pairs))
    assert got.mean_similarity == pytest.approx(sum(share) / len(pairs), abs=1e-6)
    first = [a[:20] for a in of.values()]
    assert sum(a == b for a, b in combinations(first, 2)) > got.equal_pairs
