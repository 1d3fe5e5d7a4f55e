"""Registry machinery shared by the query catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def register(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


def finish(df: DataFrame, digits: int = DIGITS, keep: tuple[str, ...] = (), per_column: dict[str, int] | None = None) -> DataFrame:
    """Round every double/float output column to ``digits`` places (the oracle
    rounds the same way), leaving other columns as they are. Columns in
    ``keep`` (input values passed through) stay exact; ``per_column`` sets
    fewer places for large-magnitude sums."""
    per_column = per_column or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in keep:
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), per_column.get(f.name, digits)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL: round a double expression like :func:`finish`."""
    return f"round(CAST({expr} AS DOUBLE), {digits})"
