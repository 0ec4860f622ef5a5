"""All queries of the catalog engine and their SQL, by name. Modules of quarry.plans register theirs with @query."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; sql says the same for DuckDB, where SQL can."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


for _name in ("text", "relational", "aggregates", "windows", "search", "retrieval", "maintenance", "extraction", "portals", "pages", "state", "rules", "streams"):
    importlib.import_module(f"quarry.plans.{_name}")
