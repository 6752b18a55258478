"""Named queries and, where SQL can say the same, the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double for value comparison."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [r(n, digits).alias(n) for n in names]
