"""Where queries and their SQL twins are kept by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def bucket_sql(seed: int, key: str) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {key}), 1, 8))::BIGINT / 4294967295.0::DOUBLE)"


def split_sql(seed: int, key: str) -> str:
    return f"CASE WHEN {bucket_sql(seed, key)} < 0.9::DOUBLE THEN 'train' WHEN {bucket_sql(seed, key)} < 0.9::DOUBLE + 0.05::DOUBLE THEN 'validation' ELSE 'test' END"
