"""A place for registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str, str | None], Callable[[Query], Query]]]:
    """(queries, their SQL, a decorator that puts a function among them)."""
    queries: dict[str, Query] = {}
    oracle: dict[str, str] = {}

    def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            queries[name] = f
            if sql:
                oracle[name] = sql
            return f

        return put

    return queries, oracle, query
