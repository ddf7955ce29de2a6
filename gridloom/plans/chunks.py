"""Yearly plan: which part and calendar year of each dataset is computed, and under which name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.names import OUTPUT_PREFIX, output_name, task_label
from gridloom.schemas import CHUNK
from gridloom.shared import materialise

DEFAULT_SCALE = 1000


def with_scale(catalog: DataFrame, scales: DataFrame, default: int = DEFAULT_SCALE) -> DataFrame:
    """Scale of each dataset: configured value, else the catalog's, else the default."""
    configured = scales.select("dataset_id", F.col("scale").alias("_configured"))
    chosen = F.coalesce(F.col("_configured"), F.col("scale"), F.lit(default))
    return catalog.join(configured, "dataset_id", "left").withColumn("scale", chosen).drop("_configured")


def year_chunks(catalog: DataFrame) -> DataFrame:
    """One row per dataset, part and calendar year ``[chunk_start, chunk_end)``; one per part for static images.

    Years run from the first four characters of ``start`` to those of ``end``, both included. Only a collection
    group uses all of its assets.
    """
    is_static = F.col("kind") == "image"
    used = F.when(F.col("kind") == "collection_group", F.col("assets")).otherwise(F.slice("assets", 1, 1))
    first, last = (F.substring(name, 1, 4).cast("int") for name in ("start", "end"))
    years = (
        F.when(is_static, F.array(F.lit(None).cast("int")))
        .when(first <= last, F.sequence(first, last))
        .otherwise(F.array().cast("array<int>"))
    )
    parts = catalog.withColumn("n_parts", F.size(used)).select("*", F.posexplode(used).alias("part", "asset_id"))
    dated = parts.withColumn("year", F.explode(years))
    return dated.withColumns(
        {
            "chunk_start": F.make_date("year", F.lit(1), F.lit(1)),
            "chunk_end": F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)),
        }
    )


def named_chunks(chunks: DataFrame, prefix: str = OUTPUT_PREFIX) -> DataFrame:
    """Chunks with output name and task label.

    A year is labelled up to ``-12-31`` although its period ends before the next January 1st; a static image
    carries the catalog's own dates.
    """
    year = F.col("year").cast("string")
    label_start = F.coalesce(F.concat(year, F.lit("-01-01")), F.col("start"))
    label_end = F.coalesce(F.concat(year, F.lit("-12-31")), F.col("end"))
    scale = F.coalesce(F.col("scale"), F.lit(DEFAULT_SCALE))
    name = output_name(
        F.col("dataset_id"), F.col("vars"), F.col("part"), F.col("n_parts"), label_start, label_end, scale, prefix
    )
    label = task_label(F.col("dataset_id"), F.col("part"), F.col("year"))
    return chunks.withColumns({"out_name": name, "task_label": label})


def join_plan(px: DataFrame, plan: DataFrame) -> DataFrame:
    """Observations with the chunk of their dataset, part and year.

    A chunk is a calendar year, so the period test becomes an equality the join can place rows by. The plan is
    written first: its size is then known, and while small it is broadcast and no observation moves. The datasets and
    years it spans are filters of the scan, so a table stored by them reads those folders only.
    """
    dated = px if "year" in px.columns else px.withColumn("year", F.year("ts"))
    written = materialise(plan, "plan")
    # As many ids as the catalog has datasets, which the plan was made from.
    span = written.agg(F.collect_set("dataset_id").alias("ids"), F.min("year").alias("low"), F.max("year").alias("high")).first()
    needed = dated.where(F.col("dataset_id").isin(span["ids"]) & F.col("year").between(F.lit(span["low"]), F.lit(span["high"])))
    return needed.join(written, list(CHUNK))


def chunk_sizes(px: DataFrame, plan: DataFrame) -> DataFrame:
    """Images and pixels found for every chunk of the plan; 0 for an empty one.

    Observations are counted per chunk before they meet the plan.
    """
    dated = px if "year" in px.columns else px.withColumn("year", F.year("ts"))
    per_scene = dated.groupBy(*CHUNK, "scene_id").agg(F.count("*").alias("pixels"))
    found = per_scene.groupBy(*CHUNK).agg(F.count("*").alias("n_img"), F.sum("pixels").alias("n_px"))
    return plan.join(found, list(CHUNK), "left").fillna(0, ["n_img", "n_px"])
