"""Registered queries: each takes (spark, sf_dir) and stands beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SAMPLE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def query(sql: str | None, name: str | None = None):
    """Registers a query under its own or another name, with its SQL where SQL can express it."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in SAMPLE}


def load_all() -> None:
    """Imports the modules that register queries."""
    from relweave.queries import constraints, data, metadata, storage, views  # noqa: F401
