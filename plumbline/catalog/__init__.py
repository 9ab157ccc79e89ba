"""Registered queries: each pairs a Spark plan with the SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

MODULES = (
    "relational aggregates windows cleaning similarity profiling layers statistics drift privacy sources streams audit"
).split()


class Tables:
    """Lazy reader: ``t.orders`` is the orders parquet under one data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its checking SQL if there is one."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(Tables(spark, root))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        run.__wrapped__ = fn
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


@lru_cache(maxsize=1)
def load() -> None:
    for m in MODULES:
        import_module(f"plumbline.catalog.{m}")
