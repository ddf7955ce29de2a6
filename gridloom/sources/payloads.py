"""Raw payloads and output files: listings without content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.paths import DEFAULT_SUFFIX, payload_class, suffix


def _listing(spark: SparkSession, root: str, name_glob: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", name_glob).option("recursiveFileLookup", "true")
    return reader.load(root).select("path", "length")


def dispatch(files: DataFrame) -> DataFrame:
    """Suffix (``.bin`` where there is none) and class of each ``path``."""
    found = suffix(F.col("path"))
    with_suffix = files.withColumn("suffix", F.when(found == "", F.lit(DEFAULT_SUFFIX)).otherwise(F.lower(found)))
    return with_suffix.withColumn("payload_class", payload_class(F.col("suffix")))


def raw_payloads(spark: SparkSession, root: str, name_glob: str = "*") -> DataFrame:
    """Files below ``root`` with size, suffix and class; contents are not read.

    As in every Spark file source, empty files and names that begin with a dot or underscore are left out.
    """
    return dispatch(_listing(spark, root, name_glob))


def payload_grid(payloads: DataFrame) -> DataFrame:
    """A payload of unknown schema as a 1x1 grid whose value is its size in bytes."""
    return payloads.withColumns(
        {"y": F.lit(0.0), "x": F.lit(0.0), "value": F.col("length").cast("float")}
    ).drop("length")


def file_inventory(spark: SparkSession, roots: dict[str, str], name_glob: str = "*.parquet") -> DataFrame:
    """Output files of each family with their sizes."""
    families = [
        _listing(spark, root, name_glob).withColumn("family", F.lit(family)) for family, root in roots.items()
    ]
    return reduce(DataFrame.unionByName, families)
