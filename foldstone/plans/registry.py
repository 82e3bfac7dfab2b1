"""Named queries over the supplied tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def micros(name: str, alias: str | None = None) -> Column:
    return F.unix_micros(name).alias(alias or name)


def as_double(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name).cast("double"), digits).alias(name)


def joined(name: str, sep: str = "|") -> Column:
    return F.array_join(name, sep).alias(name)
