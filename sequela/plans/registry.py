"""Named queries over the test tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sequela.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, folder) -> DataFrame`` under its own name."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(use_utc(spark), folder)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add
