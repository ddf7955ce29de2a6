"""Per-pixel composites over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.filters import filter_date
from gridloom.operators.medians import TASK_ROWS, median_by
from gridloom.schemas import CELL, CHUNK
from gridloom.sources.pixels import value_bands


def yearly_median(
    px: DataFrame,
    bands: list[str] | None = None,
    keys: tuple[str, ...] = CHUNK + CELL,
    task_rows: int = TASK_ROWS,
    keep: bool = False,
) -> DataFrame:
    """Median of every band per dataset, part, calendar year and pixel; masked values are ignored.

    ``keep`` is for a filtered or clipped input: it is written down narrowed, and read once (see ``median_by``).
    """
    dated = px if "year" in px.columns else px.withColumn("year", F.year("ts"))
    return median_by(dated, list(keys), bands or value_bands(px), task_rows, keep)


def period_mean(px: DataFrame, start: str, end: str, bands: list[str], keys: tuple[str, ...] = ("dataset_id",) + CELL) -> DataFrame:
    """Mean of the bands per pixel over ``[start, end)``."""
    return filter_date(px, start, end).groupBy(*keys).agg(*[F.avg(band).alias(band) for band in bands])


def grid_keys(grid: DataFrame) -> list[str]:
    """Columns that tell the datasets of a grid apart, as far as it has them."""
    return [name for name in ("dataset_id", "part") if name in grid.columns]


def time_mean(grid: DataFrame) -> DataFrame:
    """Mean over time per dataset, variable and grid point, NaN ignored; an untimed grid is returned as it is."""
    if "time" not in grid.columns:
        return grid
    number = F.nanvl("value", F.lit(None).cast("double"))
    return grid.groupBy(*grid_keys(grid), "var", "y", "x").agg(F.avg(number).alias("value"))


def time_mean_wide(px: DataFrame, bands: list[str], y: str = "lat", x: str = "lon") -> DataFrame:
    """``time_mean`` of observations with a column per band: bands are averaged side by side and unpivoted afterwards."""
    keys = grid_keys(px)
    means = [F.avg(F.nanvl(F.col(b).cast("double"), F.lit(None).cast("double"))).alias(b) for b in bands]
    image = px.groupBy(*keys, F.col(y).alias("_y"), F.col(x).alias("_x")).agg(*means)
    pairs = [F.struct(F.lit(b).alias("var"), F.col("_y").alias("y"), F.col("_x").alias("x"), F.col(b).alias("value")) for b in bands]
    return image.select(*keys, F.inline(F.array(*pairs)))


def to_grid(px: DataFrame, bands: list[str], y: str = "lat", x: str = "lon") -> DataFrame:
    """Observations as long grid rows ``(dataset_id, part, var, time, y, x, value)``, of the first two what there is."""
    pairs = [F.struct(F.lit(b).alias("var"), F.col(b).cast("double").alias("value")) for b in bands]
    keys = grid_keys(px)
    return px.select(
        *keys, F.col("ts").cast("date").alias("time"), F.col(y).alias("y"), F.col(x).alias("x"), F.inline(F.array(*pairs))
    ).select(*keys, "var", "time", "y", "x", "value")


def map_scenes(px: DataFrame, function, *args) -> DataFrame:
    """Apply a DataFrame function to every scene of a collection; all scenes are handled in one plan."""
    return px.transform(function, *args)
