"""Polygon features: GeoJSON to rings and edges, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.schemas import FEATURE, FEATURE_COLLECTION


def _rings(geometry: Column) -> Column:
    """Rings of a Polygon or MultiPolygon as arrays of positions."""
    text = geometry["coordinates"]
    polygon = F.from_json(text, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    return F.when(geometry["type"] == "MultiPolygon", multi).otherwise(polygon)


def boundary(spark: SparkSession, path: str, pick: str = "all", layout: str = "collection") -> DataFrame:
    """Features ``(fid, properties, rings)``.

    ``collection``: one FeatureCollection document, features numbered by position. ``lines``: one feature per
    line with its ``id``; this layout is split among tasks. An id that is no whole number, or none, is replaced by a
    negative hash of the feature. Lines equal in id, properties and geometry are one feature, for any kind of id; lines
    that share an id and differ are parts of it and all stay. ``pick='first'`` keeps only the lowest fid.
    """
    if layout == "lines":
        lines = spark.read.schema(FEATURE).json(path)
        made = -1 - F.abs(F.xxhash64("id", F.to_json("properties"), "geometry") % (1 << 62))
        numbered = lines.withColumn("fid", F.coalesce(F.col("id").try_cast("bigint"), made))
        equal = numbered.withColumn("_properties", F.to_json("properties")).dropDuplicates(["id", "_properties", "geometry"])
        features = equal.drop("id", "_properties")
    else:
        document = spark.read.schema(FEATURE_COLLECTION).json(path, multiLine=True)
        features = document.select(F.posexplode("features").alias("fid", "feature")).select(
            F.col("fid").cast("bigint"), "feature.properties", "feature.geometry"
        )
    shaped = features.select("fid", "properties", _rings(F.col("geometry")).alias("rings"))
    if pick == "first":
        lowest = shaped.agg(F.min("fid").alias("fid")).scalar()
        return shaped.where(F.col("fid") == lowest)
    return shaped


def edges(features: DataFrame) -> DataFrame:
    """One row per polygon side ``(fid, ring, x1, y1, x2, y2)``; open rings are closed."""
    rings = features.select("fid", F.posexplode("rings").alias("ring", "points"))
    closed = F.when(
        F.element_at("points", 1) == F.element_at("points", -1), F.col("points")
    ).otherwise(F.concat("points", F.slice("points", 1, 1)))
    sides = F.zip_with(
        F.slice("points", F.lit(1), F.size("points") - 1),
        F.slice("points", F.lit(2), F.size("points") - 1),
        lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")),
    )
    return (
        rings.where(F.size("points") > 0)
        .withColumn("points", closed)
        .select("fid", "ring", F.explode(sides).alias("side"))
        .select("fid", "ring", "side.*")
    )


def filter_features(features: DataFrame, column: str, value: str) -> DataFrame:
    """Features whose attribute equals ``value``; a column or a property."""
    field = F.col(column) if column in features.columns else F.try_element_at("properties", F.lit(column))
    return features.where(field == value)


def total_bounds(sides: DataFrame) -> DataFrame:
    """One row ``west, south, east, north`` around all sides."""
    return sides.agg(
        F.min(F.least("x1", "x2")).alias("west"),
        F.min(F.least("y1", "y2")).alias("south"),
        F.max(F.greatest("x1", "x2")).alias("east"),
        F.max(F.greatest("y1", "y2")).alias("north"),
    )
