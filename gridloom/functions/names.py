"""Deterministic names: outputs, task labels, folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output prefix and the folder of each dataset family.
OUTPUT_PREFIX = "OG"
RASTER_FOLDER = "01_gee_rasters/"
EXTERNAL_FOLDER = "02_independent/"


def output_name(
    dataset_id: Column,
    vars_: Column,
    part: Column,
    n_parts: Column,
    start: Column,
    end: Column,
    scale: Column,
    prefix: str = OUTPUT_PREFIX,
) -> Column:
    """``{prefix}_{id}_{vars}[_partN]_{start}_{end}_{scale}m``; the part tag only where there are several."""
    part_tag = F.when(n_parts > 1, F.concat(F.lit("_part"), (part + 1).cast("string"))).otherwise("")
    stem = F.concat(F.lit(prefix + "_"), dataset_id, F.lit("_"), vars_, part_tag)
    return F.concat_ws("_", stem, start, end, F.concat(scale.cast("string"), F.lit("m")))


def task_label(dataset_id: Column, part: Column, year: Column) -> Column:
    """``{id}_{part index}_{year}``, or ``static`` for an image without years."""
    return F.concat_ws("_", dataset_id, part.cast("string"), F.coalesce(year.cast("string"), F.lit("static")))


def subfolder(dataset_id: Column, folder: Column) -> Column:
    """Output folder below its family's root, told by the id's prefix."""
    root = F.when(dataset_id.startswith("01"), F.lit(RASTER_FOLDER)).otherwise(F.lit(EXTERNAL_FOLDER))
    return F.concat(root, folder)
