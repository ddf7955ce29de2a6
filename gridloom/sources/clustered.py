"""Pixel tables clustered by place: a pixel's observations lie in one bucket, neighbouring pixels close together in it.

The table is partitioned by dataset and year, bucketed by ``row, col``, and each bucket sorted along a Z-order curve. Reductions
over a pixel's observations then need no shuffle, since Spark reads a bucket as one partition, and a small box touches
few row groups. The layout is a table of the session's catalog over files elsewhere; another session registers it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.values import z_order

#: Folder beside the rows that tells the number of buckets and the columns.
_LAYOUT = "_layout"
#: Rows of a bucket where their number is not given, about, and fewest buckets.
BUCKET_ROWS, FEWEST = 1 << 20, 4


def place_key(row: str = "row", col: str = "col") -> Column:
    """Place of a pixel on the Z-order curve."""
    return z_order(F.col(row), F.col(col))


def buckets_for(rows: int) -> int:
    """Buckets, ``FEWEST`` at least, that hold some ``BUCKET_ROWS`` of so many rows each."""
    return max(FEWEST, -(-rows // BUCKET_ROWS))


def write_clustered(px: DataFrame, path: str, buckets: int | None = None, rows_in_group: int = 100_000) -> None:
    """Store observations by dataset and year in ``buckets`` buckets of ``row, col``, sorted along the Z-order curve.

    A bucket of all years is one task's work, here and for readers, which have as many partitions. Without ``buckets`` the
    rows are counted first and their number grows with them, so a bucket does not. Rows are placed once, by bucket.
    """
    spark = px.sparkSession
    buckets = buckets or buckets_for(px.count())
    dated = px if "year" in px.columns else px.withColumn("year", F.year("ts"))
    sort = ["dataset_id", "year", "place"]
    placed = dated.withColumn("place", place_key()).repartition(buckets, "row", "col").sortWithinPartitions(*sort)
    name = f"clustered_{uuid.uuid4().hex}"
    writer = placed.write.partitionBy("dataset_id", "year").bucketBy(buckets, "row", "col").sortBy("place")
    # Row groups end at this many rows at the latest; Parquet checks its size now and then.
    writer = writer.option("path", f"{path}/rows").option("parquet.block.row.count.limit", str(rows_in_group))
    writer.format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    told = [(buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema))]
    spark.createDataFrame(told, "buckets int, columns string").write.parquet(f"{path}/{_LAYOUT}")


def clustered(spark: SparkSession, path: str) -> DataFrame:
    """Observations that ``write_clustered`` stored, with its layout known to Spark."""
    layout = spark.read.parquet(f"{path}/{_LAYOUT}").first()
    name = f"clustered_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} ({layout['columns']}) USING parquet PARTITIONED BY (dataset_id, year) "
            f"CLUSTERED BY (row, col) SORTED BY (place) INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'"
        )
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name).drop("place")


def in_box(px: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Pixels of a box of rows and columns, ends included."""
    return px.where(F.col("row").between(*rows) & F.col("col").between(*cols))

