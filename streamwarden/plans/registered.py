"""Collects the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return keep


HOUR, MINUTE = 3_600_000, 60_000


def win(range_ms: int, step_ms: int, source: str = "events") -> str:
    """SQL of rows times their windows; ``ws``/``we`` in milliseconds."""
    overlap = -(-range_ms // step_ms)
    return (
        f"e as (select *, epoch_us(ts) u, cast(round(value * 100) as bigint) cents from {source}), "
        f"w as (select e.*, ((u // {step_ms * 1000}) * {step_ms} - g * {step_ms}) ws, "
        f"((u // {step_ms * 1000}) * {step_ms} - g * {step_ms} + {range_ms}) we "
        f"from e, range({overlap}) t(g) where ((u // {step_ms * 1000}) - g) * {step_ms * 1000} + {range_ms * 1000} > u)"
    )
