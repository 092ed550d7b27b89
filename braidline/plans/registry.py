"""Named queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from braidline.scratch import apart

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        """Register a function of a table reader: t("events") is that table."""

        def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self.queries:
                raise ValueError(f"{name} is there already")
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                apart(spark)
                return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return f

        return register
