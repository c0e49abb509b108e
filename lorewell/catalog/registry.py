"""All queries of the library but those of the optional corpus package."""

from __future__ import annotations

from . import chats, items, progress, search, segments, tables, texts

MODULES = (search, segments, items, chats, progress, texts, tables)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
