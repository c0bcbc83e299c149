"""Named queries and their DuckDB oracle SQL.

Each query is a callable (spark, sf_dir) -> DataFrame over the driver's
tables (or views Spark derives from them). Where plain SQL can express the
same result, an oracle string is registered next to it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco
