"""Registry of named queries: a Spark builder and (when SQL can say it) the
DuckDB oracle text for the same result.

Every builder takes ``(spark, sf_dir)`` and reads the shared tables through
``Bridge``; nothing runs on made-up input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bridge import Bridge

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(b: Bridge) -> DataFrame`` under ``name``."""
    def deco(fn: Callable[[Bridge], DataFrame]) -> Callable[[Bridge], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: _fn(Bridge(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: Column | str) -> Column:
    """Round float outputs to 6 places so both engines print the same digits."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


def load_all() -> None:
    """Import every query module so that its decorators run."""
    from . import (q_clean, q_curves, q_features, q_forecast, q_kpi, q_metrics, q_more,  # noqa: F401
                   q_profile, q_registry, q_stream, q_text)
