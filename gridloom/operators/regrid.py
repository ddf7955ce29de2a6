"""Nearest-neighbour regridding to a projected master grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.projection import EPSG_5070, Albers, project, unproject
from gridloom.operators.clip import apply_mask
from gridloom.operators.quadtree import Quadtree
from gridloom.sources.boundary import total_bounds

#: Target cells along the side of a block, which one task makes and looks up.
BLOCK = 256
#: Native grids: reference system, outer corner of cell (0, 0) and cell sizes in its unit, one row per dataset.
GRIDS = "dataset_id string, crs string, x0 double, y0 double, dx double, dy double"
#: Fixed names of the two reference systems a native grid may have.
GEOGRAPHIC, PROJECTED = "EPSG:4326", "EPSG:5070"


@dataclass(frozen=True)
class MasterGrid:
    """Target grid: lower-left corner in projected metres, cell size, and shape."""

    x0: float
    y0: float
    scale: float
    n_cols: int
    n_rows: int


@dataclass(frozen=True)
class SourceGrid:
    """Regular lon/lat grid: outer corner of cell (0, 0) and cell sizes in degrees."""

    lon0: float
    lat0: float
    d_lon: float
    d_lat: float


def covering_grid(sides: DataFrame, scale: float, crs: Albers = EPSG_5070) -> MasterGrid:
    """Grid of ``scale`` metres, aligned to multiples of it, that covers the projected features."""
    (ax, ay), (bx, by) = project(F.col("x1"), F.col("y1"), crs), project(F.col("x2"), F.col("y2"), crs)
    box = total_bounds(sides.select(ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))).first()
    x0, y0 = math.floor(box.west / scale) * scale, math.floor(box.south / scale) * scale
    return MasterGrid(x0, y0, scale, math.ceil((box.east - x0) / scale), math.ceil((box.north - y0) / scale))


def master_cells(spark: SparkSession, grid: MasterGrid) -> DataFrame:
    """Target cells ``(grid_row, grid_col, x, y)`` with projected centres, generated in parallel."""
    at = F.col("id")
    cells = spark.range(grid.n_cols * grid.n_rows).select(
        F.floor(at / grid.n_cols).alias("grid_row"), (at % grid.n_cols).alias("grid_col")
    )
    return cells.withColumns(
        {
            "x": F.lit(grid.x0) + (F.col("grid_col") + 0.5) * F.lit(grid.scale),
            "y": F.lit(grid.y0) + (F.col("grid_row") + 0.5) * F.lit(grid.scale),
        }
    )


def gather_index(cells: DataFrame, source: SourceGrid, crs: Albers = EPSG_5070) -> DataFrame:
    """For each target cell the source ``row, col`` that holds its centre."""
    lon, lat = unproject(F.col("x"), F.col("y"), crs)
    return cells.withColumns(
        {"row": F.floor((lat - source.lat0) / source.d_lat), "col": F.floor((lon - source.lon0) / source.d_lon)}
    )


def regrid_nearest(composite: DataFrame, index: DataFrame) -> DataFrame:
    """Target cells with the values of their source pixel.

    Give it a composite, not raw scenes: picking a source pixel commutes with reducing that pixel over time, and
    the composite is smaller by the number of scenes.
    """
    return index.join(composite, ["row", "col"]).drop("row", "col")


def target_blocks(grids: DataFrame, sides: DataFrame, crs: Albers = EPSG_5070, block: int = BLOCK) -> DataFrame:
    """Blocks of each dataset's master grid: ``grids(dataset_id, scale, ...)`` with ``left, bottom, n_cols, n_rows`` and the block.

    A dataset's master grid has cells of its ``scale`` metres, aligned to multiples of it, and covers the projected features.
    """
    (ax, ay), (bx, by) = project(F.col("x1"), F.col("y1"), crs), project(F.col("x2"), F.col("y2"), crs)
    box = total_bounds(sides.select(ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))).first()
    if box.west is None:
        return grids.withColumns({c: F.lit(0) for c in ("left", "bottom", "n_cols", "n_rows", "block_row", "block_col")}).where(F.lit(False))
    scale = F.col("scale").cast("double")
    placed = grids.withColumns({"left": F.floor(F.lit(box.west) / scale) * scale, "bottom": F.floor(F.lit(box.south) / scale) * scale})
    sized = placed.withColumns(
        {"n_cols": F.ceil((F.lit(box.east) - F.col("left")) / scale), "n_rows": F.ceil((F.lit(box.north) - F.col("bottom")) / scale)}
    )
    zero = F.lit(0).cast("long")
    blocks = sized.withColumn("block_row", F.explode(F.sequence(zero, F.floor((F.col("n_rows") - 1) / block))))
    blocks = blocks.withColumn("block_col", F.explode(F.sequence(zero, F.floor((F.col("n_cols") - 1) / block))))
    return blocks.repartition("dataset_id", "block_row", "block_col")


def block_cells(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """The cells of each block ``(..., grid_row, grid_col, x, y)`` with projected centres; a block's are made in its task."""

    def numbers(of: str, n: str) -> Column:
        first = F.col(of) * block
        return F.explode(F.sequence(first, F.least(first + block, F.col(n)) - 1))

    cells = blocks.withColumn("grid_row", numbers("block_row", "n_rows")).withColumn("grid_col", numbers("block_col", "n_cols"))
    x, y = (F.col(a) + (F.col(c) + 0.5) * F.col("scale") for a, c in (("left", "grid_col"), ("bottom", "grid_row")))
    return cells.withColumns({"x": x, "y": y}).drop("left", "bottom", "n_cols", "n_rows", "block_row", "block_col")


def source_index(grids: DataFrame, sides: DataFrame, mask: Quadtree | None, crs: Albers = EPSG_5070, block: int = BLOCK) -> DataFrame:
    """Target cells inside the features, ``(dataset_id, grid_row, grid_col, x, y, row, col)``: where each takes its value from.

    ``grids`` has the columns of ``GRIDS`` and ``scale``; every dataset has its own native grid, reference system and scale.
    Cells whose centre is outside the features are left out, which clips on the target grid.
    """
    cells = block_cells(target_blocks(grids.withColumnsRenamed({"x0": "_x0", "y0": "_y0"}), sides, crs, block), block)
    lon, lat = unproject(F.col("x"), F.col("y"), crs)
    inside = apply_mask(cells.withColumns({"_lon": lon, "_lat": lat}), mask, "_lon", "_lat")
    other = F.raise_error(F.concat(F.lit("unknown reference system "), F.coalesce("crs", F.lit("NULL")))).cast("double")
    u = F.when(F.col("crs") == GEOGRAPHIC, F.col("_lon")).when(F.col("crs") == PROJECTED, F.col("x")).otherwise(other)
    v = F.when(F.col("crs") == GEOGRAPHIC, F.col("_lat")).when(F.col("crs") == PROJECTED, F.col("y")).otherwise(other)
    row, col = F.floor((v - F.col("_y0")) / F.col("dy")), F.floor((u - F.col("_x0")) / F.col("dx"))
    return inside.select("dataset_id", "grid_row", "grid_col", "x", "y", row.alias("row"), col.alias("col"))


def gather(composite: DataFrame, index: DataFrame) -> DataFrame:
    """Target cells of every dataset and chunk with the values of their source pixel; its place on the native grid goes."""
    values = composite.drop("lon", "lat")
    return index.join(values, ["dataset_id", "row", "col"]).drop("row", "col")
