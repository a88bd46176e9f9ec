"""All queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from graphloom.queries import actors, graph, processing, schema, stores, whole

_MODULES = (graph, whole, schema, actors, stores, processing)


def queries() -> dict[str, Callable]:
    """Name to callable (spark, folder) -> DataFrame."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
