"""The registry of queries: name -> function of (spark, sf_dir), and name -> equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query, with its SQL where SQL can express it."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = sql
        return f

    return keep


def _load() -> None:
    for name in ("join_queries", "aggregate_queries", "window_queries", "relational_queries", "scalar_queries", "estimator_queries", "stream_queries", "board_queries", "model_queries", "source_queries", "service_queries"):
        if (Path(__file__).parent / f"{name}.py").exists():
            import_module(f"tidelake.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
