"""Registered queries: a name, a Spark callable and, where SQL can express it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "pricing_summary"
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _ORACLE[function.__name__] = sql
        return function

    return add


def _loaded() -> None:
    from skein.plans import aggregates, articles, documents, files, filters, frames, joins, prose, queues, recording, relational, releases, reports, reviews, searches, star, states, stories, texts, windows  # noqa: F401


def queries() -> dict[str, Query]:
    _loaded()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _loaded()
    return _ORACLE
