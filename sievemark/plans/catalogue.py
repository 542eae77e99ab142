"""Registry of the core's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that states the same result."""

    def register(made: Query) -> Query:
        QUERIES[name] = made
        if sql is not None:
            SQL[name] = sql
        return made

    return register
