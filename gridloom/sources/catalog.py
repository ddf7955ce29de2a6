"""Dataset catalog: records, asset lists, configured scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.schemas import CATALOG_DOCUMENT, CATALOG_RECORD

FAMILY_KEYS = {"datasets": "raster", "independent_datasets": "external"}


def asset_list(asset: Column) -> Column:
    """Assets as a list, whether the record holds one string or a JSON list."""
    listed = F.from_json(asset, "array<string>")
    return (
        F.when(F.coalesce(F.trim(asset), F.lit("")) == "", F.array().cast("array<string>"))
        .when(F.ltrim(asset).startswith("["), listed)
        .otherwise(F.array(asset))
    )


def _tidy(records: DataFrame) -> DataFrame:
    fields = [f.name for f in CATALOG_RECORD.fields if f.name != "asset_id"]
    return records.select("dataset_id", "family", asset_list(F.col("asset_id")).alias("assets"), *fields)


def catalog(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """One row per dataset.

    ``document``: one JSON document mapping ids to records, per family. ``records``: JSON lines, one record per
    line with its ``dataset_id`` and ``family``; this layout is split among tasks, so use it for large catalogs.
    """
    if layout == "records":
        return _tidy(spark.read.schema(_record_line_schema()).json(path))
    document = spark.read.schema(CATALOG_DOCUMENT).json(path, multiLine=True)
    families = [
        document.select(F.explode(key).alias("dataset_id", "record")).select(
            "dataset_id", F.lit(family).alias("family"), "record.*"
        )
        for key, family in FAMILY_KEYS.items()
    ]
    return _tidy(families[0].unionByName(families[1]))


def _record_line_schema() -> str:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CATALOG_RECORD.fields)
    return f"dataset_id STRING, family STRING, {fields}"


def master_scales(spark: SparkSession, path: str) -> DataFrame:
    """Configured scale per dataset id, from the catalog document."""
    document = spark.read.schema(CATALOG_DOCUMENT).json(path, multiLine=True)
    return document.select(F.explode("MASTER_SCALE").alias("dataset_id", "scale"))


def asset_parts(records: DataFrame) -> DataFrame:
    """One row per asset with its 0-based part index."""
    return records.select("dataset_id", F.posexplode("assets").alias("part", "asset_id"))
