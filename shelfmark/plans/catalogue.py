"""The queries over the driver tables and, for each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if it has one."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def folded(*made: Query) -> None:
    """Registers queries once more by the key for all scripts (normal form and full case folding). The tables' names are ASCII, for which both keys are one: the SQL is the same."""
    for f in made:
        QUERIES[f"{f.__name__}_folded"] = partial(f, ascii_key=False)
        SQL[f"{f.__name__}_folded"] = SQL[f.__name__]


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL


def _load() -> None:
    from shelfmark.plans import codec_queries, listing_queries, media_queries, path_queries, plan_queries, session_queries  # noqa: F401
