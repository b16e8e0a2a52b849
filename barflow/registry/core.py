"""The registry: name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def r(col: Column | str, n: int, name: str | None = None) -> Column:
    """Rounded column; -0.0 becomes 0.0 so that both engines print the same."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c, n) + F.lit(0.0)
    label = name or (col if isinstance(col, str) else None)
    return out.alias(label) if label else out
