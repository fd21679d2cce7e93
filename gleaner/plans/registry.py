"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .oracle import sql as with_fragments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fragments(sql)
        return fn

    return add


def ts(col: str) -> Column:
    """Timestamps as text, so both engines print them alike."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def joined(col: str) -> Column:
    return F.array_join(col, "|").alias(col)
