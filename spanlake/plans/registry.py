"""Registry of named queries and their DuckDB oracle SQL.

Each query module registers ``name -> fn(spark, sf_dir) -> DataFrame`` and, where
the operator is SQL-expressible, the equivalent DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # Importing the modules registers their queries.
    from spanlake.plans import (q_retrieval, q_text, q_checks, q_windows,  # noqa: F401
                                q_decode, q_evaluate, q_ensemble, q_splits,
                                q_scoring, q_io, q_pipeline)


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
