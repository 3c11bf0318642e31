"""Where queries are registered, each name once, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from missive.scratch import bounded_batches
from missive.views import Views, sql, stored, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"there is a query {name} already")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


def over_views(name: str, oracle: str | None = None):
    """Register a query that takes the message model."""

    def add(f: Callable[[Views], DataFrame]):
        register(name, lambda spark, sf_dir: f(views(spark, sf_dir)), oracle and sql(oracle))
        return f

    return add


def over_store(name: str, oracle: str | None = None):
    """Register a query that takes the stored message model with its index."""

    def add(f: Callable[[Views], DataFrame]):
        register(name, lambda spark, sf_dir: f(stored(spark, sf_dir)), oracle and sql(oracle))
        return f

    return add


def over_tables(name: str, oracle: str | None = None):
    """Register a query that takes a reader of tables."""

    def add(f):
        register(name, lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")), oracle)
        return f

    return add
