"""Registered checks: each operator as a Spark query plus an equivalent SQL text.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``SQL[name]`` (DuckDB
dialect, on the driver's tables).  Operators whose result is not
expressible in SQL (model fits, EM rounds) register no SQL.
"""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate check {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load_all():
    from retort.suite import reactions, rows, metrics, tokens, io_checks, ml_checks  # noqa: F401
    return QUERIES, SQL
