"""Queries by name, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one folder, read on use: t.part, t.products."""

    def __init__(self, spark: SparkSession, at: str) -> None:
        self.spark, self.at = spark, at

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.at, name)


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of Tables under its name."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")
        QUERIES[key] = lambda spark, at: f(Tables(spark, at))
        if sql:
            ORACLES[key] = sql
        return f

    return put
