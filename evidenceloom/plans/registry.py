"""Where queries and their SQL register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A column's wall-clock time in Vienna, in SQL.
VIENNA = "(({} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def s(c: str) -> Column:
    return F.col(c).cast("string").alias(c)
