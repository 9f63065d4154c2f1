"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register ``fn(spark, sf_dir)`` and, when given, its SQL over the named views."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = oracle(sql, *views.split())
        return fn
    return wrap


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded double, so that both engines print the same digits."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})
