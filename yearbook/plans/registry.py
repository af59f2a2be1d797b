"""All registered queries over the declaration tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .proxy import Declarations, with_prelude

_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register f(tables) under a name; sql runs in DuckDB over the same tables."""

    def add(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"two queries are called {name}")
        _QUERIES[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Declarations(spark, sf_dir))) for name, (f, _) in _QUERIES.items()}


def functions() -> dict[str, Callable[[Declarations], DataFrame]]:
    """The same, of the tables."""
    _load()
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_prelude(sql) for name, (_, sql) in _QUERIES.items() if sql}


def _load() -> None:
    from . import entity_queries, fixed_queries, source_queries, spec_queries, text_queries  # noqa: F401
