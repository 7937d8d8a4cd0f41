"""Where queries and the SQL that says the same are put down by name."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Puts down a query under its function's name; without SQL, tests hold it against a plain version."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
