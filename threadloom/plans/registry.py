"""All core queries by name, with their SQL."""

from __future__ import annotations

from threadloom.plans import discussion_queries, metric_queries, nested_queries

MODULES = (metric_queries, discussion_queries, nested_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.oracle_sql().items()}
