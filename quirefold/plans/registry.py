"""Where the layout queries and their SQL are put down."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"
