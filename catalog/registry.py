"""Where the queries and their DuckDB answers are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.fixtures import with_fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn: Query, sql: str | None = None, fixtures: list[str] | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = with_fixtures(fixtures, sql) if fixtures else sql


def query(sql: str | None = None, fixtures: list[str] | None = None, name: str | None = None):
    """Register the decorated function under its own name or ``name``."""

    def decorate(fn: Query) -> Query:
        register(name or fn.__name__, fn, sql, fixtures)
        return fn

    return decorate
