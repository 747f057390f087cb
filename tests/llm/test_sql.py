"""Queries with SQL against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import same_rows
from tracemill.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    assert same_rows(queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLES[name]).df())
