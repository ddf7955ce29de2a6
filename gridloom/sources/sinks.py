"""Sinks for grids, manifests, quality summaries and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.attrs import CONVENTIONS
from gridloom.sources.chunks import read_chunks, write_chunks


def write_grid(grid: DataFrame, attrs: DataFrame, var_attrs: DataFrame, path: str) -> None:
    """A grid as chunked arrays and the two attribute tables, compressed, as sibling tables."""
    write_chunks(grid, f"{path}/grid")
    for name, table in {"attrs": attrs, "var_attrs": var_attrs}.items():
        table.write.parquet(f"{path}/{name}", compression="gzip")


def read_grid(spark: SparkSession, path: str, **window: tuple) -> dict[str, DataFrame]:
    """The three tables; of the grid the cells in ``window``, (least, greatest) per axis, if one is given."""
    attributes = {name: spark.read.parquet(f"{path}/{name}") for name in ("attrs", "var_attrs")}
    return {"grid": read_chunks(spark, f"{path}/grid", **window), **attributes}


def manifest(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Manifest lines ``(notebook_id, status, file, size_bytes, cf_version, dataset)`` of the files that exist.

    One line per file, whatever their number: a notebook's manifest is the lines of its folder.
    """
    existing = files.join(inventory.select("file", "size_bytes"), "file")
    return existing.select("notebook_id", "status", "file", "size_bytes", F.lit(CONVENTIONS).alias("cf_version"), "dataset")


def write_manifest(lines: DataFrame, path: str) -> None:
    """One folder of JSON lines per notebook; a large one is split among tasks."""
    lines.hint("rebalance", "notebook_id").sortWithinPartitions("notebook_id", "file").write.partitionBy("notebook_id").json(path)


def write_qc(stats: DataFrame, path: str) -> None:
    """Quality statistics as one JSON object per variable."""
    stats.select(F.to_json(F.struct(*stats.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def index_lines(files: DataFrame, n_failures: Column, title: str, written_at: Column | None = None) -> DataFrame:
    """Lines of the output index: title, when it was written, one bullet per file, counts; ``section, line`` give their order.

    Without ``written_at`` the line that tells the time is left out.
    """
    headings = {0: F.lit(f"# {title}"), 10: F.lit(""), 40: F.lit("## Files"), 60: F.lit(""), 70: F.lit("## Validation")}
    if written_at is not None:
        headings |= {20: F.concat(F.lit("Generated: "), written_at), 30: F.lit("")}
    bullet = F.format_string("- `%s` (%d bytes)", F.col("path"), F.col("length"))
    bullets = files.select(F.lit(50).alias("section"), bullet.alias("line"))
    fixed = [F.struct(F.lit(at).alias("section"), text.alias("line")) for at, text in headings.items()]
    counted = {
        80: F.format_string("- Files checked: %d", F.col("n_files")),
        90: F.format_string("- Failures: %d", n_failures),
    }
    counts = [F.struct(F.lit(at).alias("section"), text.alias("line")) for at, text in counted.items()]
    framing = files.agg(F.count("*").alias("n_files")).select(F.inline(F.array(*fixed, *counts)))
    return framing.unionByName(bullets)


def write_index(lines: DataFrame, path: str) -> None:
    """Index text in section order; part files sort in line order."""
    lines.orderBy("section", "line").select("line").write.text(path)
