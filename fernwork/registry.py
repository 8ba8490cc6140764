"""Where queries are registered, each with the SQL that gives the same rows if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernwork.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def text(name: str, statement: str, sql: str, lang: str | None = None) -> None:
    """A query given as text."""
    QUERIES[name] = lambda spark, sf: load(spark, sf).session().execute(statement, lang)
    SQL[name] = sql


def built(sql: str | None = None) -> Callable[[Query], Query]:
    """A query given as a function of the operators."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
