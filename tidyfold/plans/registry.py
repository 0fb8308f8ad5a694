"""The queries over the given tables, each registered next to its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidyfold.session import shared_folder, stable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query `(tables) -> DataFrame`; `sql` is what DuckDB runs on the same tables."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    """The given tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.kept = spark, folder, {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A small derived table a query reads several times, written once."""
        if name not in self.kept:
            self.kept[name] = stable(build())
        return self.kept[name]

    def place(self, name: str) -> str:
        """A new folder in the shared one, for what a query writes and reads back."""
        return f"{shared_folder(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
