"""Registry of named queries (driver contract) and their DuckDB oracles.

Each entry: ``name -> (build(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Queries read the driver tables through ``sources.roles``; oracle SQL reads
the same tables as DuckDB views.  Float outputs are rounded to 6 decimals on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_core, q_analytics, q_text, q_models, q_extra, q_models2, q_retrieval, q_pages, q_features  # noqa: F401
