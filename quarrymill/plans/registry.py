"""Registration of queries with the SQL that they are compared with."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` is its DuckDB equivalent over the same tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
