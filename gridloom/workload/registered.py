"""Register of queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.workload.views import portable_sql, spark_view

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Views of one scale factor, by attribute: ``inputs.px_obs``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return spark_view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register ``function(inputs)`` under ``name``, with the SQL its result must equal."""

    def register(function: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = portable_sql(sql)
        return function

    return register
