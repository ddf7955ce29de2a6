"""Axes of gridded tables: names, indexes, chunk shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.composites import grid_keys
from gridloom.operators.skew import row_number_by
from gridloom.shared import materialise

# Fixed value: longest side of a storage chunk.
CHUNK_SIDE = 24


def normalise_axes(grid: DataFrame) -> DataFrame:
    """``lat``/``lon`` become ``y``/``x`` where those are absent; then ``lat``/``lon`` repeat ``y``/``x``.

    The repeated values are projected coordinates, not degrees; true degrees come from the inverse projection.
    """
    renamed = grid
    for old, new in (("lat", "y"), ("lon", "x")):
        if old in renamed.columns and new not in renamed.columns:
            renamed = renamed.withColumnRenamed(old, new)
    for name, source in (("lat", "y"), ("lon", "x")):
        if name not in renamed.columns:
            renamed = renamed.withColumn(name, F.col(source))
    return renamed


def index_axis(grid: DataFrame, axis: str, out: str) -> DataFrame:
    """Grid with a 0-based index of the distinct values of an axis without coordinates.

    Only the distinct values are numbered; the numbers are joined back from a small table. A NULL is a value of its own,
    the first one.
    """
    numbered = row_number_by(grid.select(axis).distinct(), [], [axis], "_nth")
    lookup = materialise(numbered.select(axis, (F.col("_nth") - 1).alias(out)), "axis-index")
    return grid.join(lookup, grid[axis].eqNullSafe(lookup[axis])).drop(lookup[axis])


def chunk_shape(grid: DataFrame, axes: tuple[str, ...] = ("time", "y", "x"), side: int = CHUNK_SIDE) -> DataFrame:
    """Storage chunk length per dataset and axis: its number of distinct values, at most ``side``.

    All axes come from one pass; a row is reduced to its distinct axis values before anything is sent.
    """
    keys = grid_keys(grid)
    pairs = [F.struct(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("_value")) for axis in axes]
    values = grid.select(*keys, F.inline(F.array(*pairs))).distinct()
    together = values.groupBy(*keys, "axis").agg(F.count("_value").alias("dim"))
    return together.withColumn("chunk", F.least(F.col("dim"), F.lit(side).cast("bigint")))
