"""Pixel observations: collections, static images, collection groups, composites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.schemas import PIXEL_KEYS


# Types of the columns that folder names carry; left to itself Spark would read an id such as 01d as a number.
_FOLDER_TYPES = {"dataset_id": T.StringType(), "part": T.LongType(), "year": T.IntegerType()}


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Table stored by dataset, part and year. Giving the schema saves looking it up."""
    found = schema or spark.read.parquet(path).schema
    fields = [T.StructField(f.name, _FOLDER_TYPES.get(f.name, f.dataType)) for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def px_obs(spark: SparkSession, path: str, dataset_id: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """All pixels of a table partitioned by ``dataset_id`` and ``year``; one dataset prunes to its folder."""
    table = read_partitioned(spark, path, schema)
    return table if dataset_id is None else table.where(F.col("dataset_id") == dataset_id)


def write_px_obs(px: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store observations partitioned by dataset and year, rows of a cell close together.

    Static images have neither ``ts`` nor ``year`` and are partitioned by dataset alone. The rebalance hint splits an
    oversized folder among tasks and merges small ones.
    """
    dated = px.withColumn("year", F.year("ts")) if "ts" in px.columns and "year" not in px.columns else px
    folders = ["dataset_id", "year"] if "year" in dated.columns else ["dataset_id"]
    laid_out = dated.hint("rebalance", *folders).sortWithinPartitions(*folders, "row", "col")
    laid_out.write.mode(mode).partitionBy(*folders).parquet(path)


def static_image(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """One image without a time axis: no date filter, time column dropped."""
    return px_obs(spark, path, dataset_id).drop("ts", "year")


def collection_group(collections: list[DataFrame]) -> DataFrame:
    """Collections read together: 0-based part, 1-based name suffix only where there are several."""
    several = len(collections) > 1
    tagged = [
        px.withColumn("part", F.lit(index).cast("bigint")).withColumn(
            "part_tag", F.lit(f"_part{index + 1}" if several else "")
        )
        for index, px in enumerate(collections)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def value_bands(px: DataFrame, keys: tuple[str, ...] = PIXEL_KEYS + ("year", "part_tag", "out_name")) -> list[str]:
    """Every native band, quality bands included: the columns that are no keys."""
    return [name for name in px.columns if name not in keys]


def select_bands(px: DataFrame, bands: list[str]) -> DataFrame:
    """Key columns plus the chosen bands."""
    return px.select(*[name for name in px.columns if name in PIXEL_KEYS], *bands)


def write_composite(composite: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a composite partitioned by dataset, part and year; a large chunk is split among tasks."""
    laid_out = composite.hint("rebalance", "dataset_id", "part", "year")
    laid_out.write.mode(mode).partitionBy("dataset_id", "part", "year").parquet(path)
