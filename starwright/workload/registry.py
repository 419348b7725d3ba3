"""Registered queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Data:
    """Tables of one data folder as attributes: ``data.orders``."""

    spark: SparkSession
    folder: str
    opened: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        # opened once, so that plans over one table share its scans and exchanges
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(self.path(name))
        return self.opened[name]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(data)`` under a name."""
    def add(fn: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if sql:
            SQL[name] = sql
        return fn
    return add
