"""The list of registered queries."""

from __future__ import annotations

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    """Add a query under its function name, with the SQL it must equal where there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add
