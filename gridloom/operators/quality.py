"""Quality statistics over finite values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.values import is_finite, quicklook_byte
from gridloom.operators.composites import grid_keys, time_mean
from gridloom.shared import materialise

STATISTICS = ("min", "max", "mean", "std", "n_valid")


def _statistics(value: Column) -> dict[str, Column]:
    number = F.when(is_finite(value), value.cast("double"))
    return {
        "min": F.min(number),
        "max": F.max(number),
        "mean": F.avg(number),
        "std": F.stddev_pop(number),
        "n_valid": F.count(number),
    }


def qc_stats(grid: DataFrame) -> DataFrame:
    """Per dataset and variable of a long grid: min, max, mean, population std, count; NULLs where nothing is valid."""
    return grid.groupBy(*grid_keys(grid), "var").agg(*[column.alias(name) for name, column in _statistics(F.col("value")).items()])


def qc_stats_wide(px: DataFrame, bands: list[str]) -> DataFrame:
    """The same statistics for bands held as columns: one pass, one row per dataset, then one per band."""
    columns = [
        column.alias(f"{band}_{name}") for band in bands for name, column in _statistics(F.col(band)).items()
    ]
    rows = [
        F.struct(F.lit(band).alias("var"), *[F.col(f"{band}_{name}").alias(name) for name in STATISTICS])
        for band in bands
    ]
    keys = grid_keys(px)
    return px.groupBy(*keys).agg(*columns).select(*keys, F.inline(F.array(*rows)))


def quicklook(grid: DataFrame) -> DataFrame:
    """Grey values of the time-mean image of each dataset's variables, scaled between its minimum and maximum.

    A grid without a time axis is such an image. The image is written once, for its extremes and for the scaling. The extremes are one row per variable, read from a
    table and so broadcast: images are not placed by variable.
    """
    keys = [*grid_keys(grid), "var"]
    image = materialise(time_mean(grid).select(*keys, "y", "x", "value"), "image")
    extremes = materialise(image.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high")), "extremes")
    grey = quicklook_byte(F.col("value"), F.col("low"), F.col("high"))
    return image.join(extremes, keys).select(*keys, "y", "x", grey.alias("grey"))
