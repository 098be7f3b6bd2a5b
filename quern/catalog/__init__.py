"""Registry of queries and of their SQL, by operator."""

from __future__ import annotations

from quern.catalog import graphs, groups, matrices, models

MODULES = (matrices, groups, graphs, models)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
