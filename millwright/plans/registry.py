"""Query registry: name → (Spark plan builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables.  Oracle SQL is an independent restatement used by the
correctness gate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle_sql: str | Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle_sql is not None:
            ORACLES[name] = oracle_sql() if callable(oracle_sql) else oracle_sql
        return fn

    return deco


MODULES = [
    "q_quality", "q_features", "q_labels", "q_normalize", "q_sources", "q_sampling", "q_metrics",
    "q_scoring", "q_stream", "q_models",
]


def load_all() -> None:
    """Import the query modules (each registers its entries)."""
    import importlib

    for m in MODULES:
        importlib.import_module(f"millwright.plans.{m}")
