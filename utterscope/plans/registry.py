"""Registry of named queries over the driver tables and their SQL oracles.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle is an ANSI SQL
string over the same tables (DuckDB views named after the tables).  Queries
without an oracle are checked by row count and unit tests only.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
