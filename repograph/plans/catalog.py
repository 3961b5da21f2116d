"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return keep


def load() -> None:
    """Import the modules that register queries."""

    from repograph.plans import (  # noqa: F401
        catalog_answer,
        catalog_code,
        catalog_events,
        catalog_evolution,
        catalog_graph,
        catalog_runs,
    )
