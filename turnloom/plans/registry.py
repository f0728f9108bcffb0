"""How a module of queries declares them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function (spark, sf_dir) -> DataFrame by its name, with its DuckDB twin."""

        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
