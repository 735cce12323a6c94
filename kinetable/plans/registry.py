"""Names of queries, what runs them in Spark, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import ship
from ..tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one folder by attribute, loaded when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)


def rounded(x: Column | str, n: int) -> Column:
    """A double to ``n`` places as SQL has it: what rounds to zero keeps its sign, which Spark's ``round`` drops."""
    x = F.col(x) if isinstance(x, str) else x
    r = F.round(x, n)
    return F.when(r == 0, x * 0.0).otherwise(r)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables; ``sql`` is its oracle."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} exists")
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[key] = sql
        return f

    return add
