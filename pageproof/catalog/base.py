"""Registry of named queries with their SQL counterparts, and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pageproof.session import ship_package, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("pages", "documents", "conversations", "events", "labels", "benchmark")


class Tables:
    """The given parquet tables, by attribute, and derived inputs by SQL."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = ship_package(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return spread(table) if name in ("pages", "documents") else table

    def sql(self, text: str) -> DataFrame:
        """Run input SQL whose tables are written as {pages} and so on."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)


def duck(text: str) -> str:
    """The same input SQL for the oracle engine."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its oracle."""

    def add(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add
