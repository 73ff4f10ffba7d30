"""The registry of queries: a function of (spark, sf_dir, view) and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .adapt import oracle, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *names: str):
    """Registers a function of (spark, sf_dir, view) under its name; sql is its oracle over the views named."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir, lambda n: view(spark, sf_dir, n))
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle(sql, *names)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
