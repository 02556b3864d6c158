"""Registered queries: each runs one operator on the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional equivalent SQL text."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the given tables. ``spread`` is for costly work per row: a table of fewer
    splits than cores (one row group cannot be split) is then dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def load_all() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"tablewright.workload.{module}")


MODULES = (
    "profiling", "sqltext", "scalars", "inference", "preparation", "series", "evaluation", "vectors", "modelling", "reports",
)
