"""Yearly composite of the raster families, from observations to named outputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.clip import apply_mask, build_mask, clip
from gridloom.operators.composites import yearly_median
from gridloom.operators.filters import filter_date
from gridloom.operators.quadtree import Quadtree
from gridloom.operators.regrid import MasterGrid, SourceGrid, gather, gather_index, master_cells, regrid_nearest, source_index
from gridloom.plans.chunks import DEFAULT_SCALE, join_plan, named_chunks, year_chunks
from gridloom.schemas import CELL, CHUNK
from gridloom.shared import materialise
from gridloom.sources.pixels import read_partitioned, value_bands, write_composite


def composite(px: DataFrame, sides: DataFrame, start: str, end: str) -> DataFrame:
    """Period filter, clip, yearly median: all datasets, parts and years in one plan."""
    return yearly_median(clip(filter_date(px, start, end), sides), keep=True)


def chunk_plan(catalog: DataFrame) -> DataFrame:
    """Chunks of the collections in a catalog: ``dataset_id, part, year, out_name, scale, start, end``."""
    chunks = named_chunks(year_chunks(catalog.where("kind <> 'image'")))
    return chunks.withColumn("part", F.col("part").cast("bigint")).select(*CHUNK, "out_name", "scale", "start", "end")


def _planned(px: DataFrame, plan: DataFrame, mask: Quadtree | None, keep: bool = True) -> DataFrame:
    time_type = px.schema["ts"].dataType
    planned = join_plan(px, plan.drop("scale")).where(
        (F.col("ts") >= F.col("start").cast(time_type)) & (F.col("ts") < F.col("end").cast(time_type))
    )
    clipped = apply_mask(planned.drop("start", "end"), mask)
    return yearly_median(clipped, value_bands(px), (*CHUNK, "out_name", *CELL), keep=keep)


def named_composite(px: DataFrame, catalog: DataFrame, sides: DataFrame, keep: bool = True) -> DataFrame:
    """Composite of every planned chunk, on its native grid, with its output name.

    Dataset periods apply before the calendar years, so first and last years may be partial. The planned and clipped
    pixels are written down and the input is read once; without ``keep`` a clustered table keeps its layout up to the median.
    """
    return _planned(px, chunk_plan(catalog), build_mask(sides), keep)


def named_static(images: DataFrame, catalog: DataFrame, sides: DataFrame) -> DataFrame:
    """Clipped static images with their output names; no date filter applies to them."""
    chunks = named_chunks(year_chunks(catalog.where("kind = 'image'")))
    plan = materialise(chunks.select("dataset_id", "out_name"), "static-plan")
    return clip(images.join(plan, "dataset_id"), sides)


def regridded(composites: DataFrame, source: SourceGrid, target: MasterGrid) -> DataFrame:
    """Composite on the master grid."""
    return regrid_nearest(composites, gather_index(master_cells(composites.sparkSession, target), source))


def on_master_grids(composites: DataFrame, grids: DataFrame, sides: DataFrame, mask: Quadtree | None = None) -> DataFrame:
    """Composites of all datasets on master grids of their scales, clipped there again.

    ``grids`` names each dataset's native grid and ``scale`` (see ``regrid.source_index``). Where a target cell takes its value
    from is worked out once per dataset, not once per chunk, and chunks are gathered by an equality join.
    """
    index = source_index(grids, sides, mask or build_mask(sides))
    return gather(composites, materialise(index, "source-index"))


def export(px: DataFrame, catalog: DataFrame, grids: DataFrame, sides: DataFrame, path: str) -> None:
    """Compute and store all planned chunks on the master grid at their dataset's scale.

    ``catalog`` has the scale chosen for each dataset (``with_scale``), ``grids`` its native grid (``regrid.GRIDS``). Cells are stored
    under ``path/composites``, one row per planned chunk under ``path/chunks``, with 0 cells for a chunk without values;
    a dataset without a native grid is an error.
    """
    mask = build_mask(sides)
    plan = materialise(chunk_plan(catalog).fillna(DEFAULT_SCALE, ["scale"]), "export-plan")
    scales = plan.groupBy("dataset_id").agg(F.max("scale").alias("scale"))
    unknown = scales.join(grids, "dataset_id", "left_anti").agg(F.concat_ws(", ", F.sort_array(F.collect_set("dataset_id")))).scalar()
    lacking = F.when(unknown != "", F.raise_error(F.concat(F.lit("no native grid for "), unknown)).cast("int"))
    known = scales.where(lacking.isNull()).join(grids, "dataset_id")
    cells = on_master_grids(_planned(px, plan, mask), known, sides, mask)
    # A table of folders without any rows has no file that tells its columns.
    px.sparkSession.createDataFrame([(cells.schema.json(),)], "columns string").write.parquet(f"{path}/schema")
    write_composite(cells, f"{path}/composites")
    stored = read_partitioned(px.sparkSession, f"{path}/composites", cells.schema)
    counts = stored.groupBy(*CHUNK).agg(F.count("*").alias("n_px"))
    plan.drop("start", "end").join(counts, list(CHUNK), "left").fillna(0, ["n_px"]).write.parquet(f"{path}/chunks")


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells and chunks that ``export`` stored."""
    told = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()["columns"]))
    return read_partitioned(spark, f"{path}/composites", told), spark.read.parquet(f"{path}/chunks")
