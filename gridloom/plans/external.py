"""Ingest of external datasets: gate, land as grids, attributes, quality summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.attrs import coordinate_attrs, global_attrs, variable_attrs
from gridloom.functions.names import output_name
from gridloom.functions.status import format_iso
from gridloom.functions.values import to_fill
from gridloom.operators.axes import normalise_axes
from gridloom.operators.filters import needs_configuration
from gridloom.operators.quality import qc_stats
from gridloom.sources.payloads import payload_grid
from gridloom.sources.sinks import write_grid, write_qc


def configured(catalog: DataFrame) -> DataFrame:
    """External datasets that can be fetched."""
    return catalog.where((F.col("family") == "external") & ~needs_configuration(F.col("endpoint")))


def named_external(catalog: DataFrame, start: str, end: str, scale: int = 1000) -> DataFrame:
    """External datasets with the output name of the whole period."""
    name = output_name(
        F.col("dataset_id"), F.col("vars"), F.lit(0), F.lit(1), F.lit(start), F.lit(end), F.lit(scale)
    )
    return catalog.withColumn("out_name", name)


def ingest_payloads(payloads: DataFrame, catalog: DataFrame, path: str) -> DataFrame:
    """Land payloads ``(dataset_id, length)`` as provenance grids and return their quality statistics.

    Grid rows, dataset attributes and variable attributes are written below ``path``.
    """
    ready = configured(catalog)
    landed = payloads.join(ready.select("dataset_id", "vars"), "dataset_id")
    grid = normalise_axes(payload_grid(landed)).withColumnRenamed("vars", "var")
    given = F.create_map(
        F.lit("title"), F.coalesce("name", F.lit("")), F.lit("notebook_id"), F.col("dataset_id"), F.lit("source"), F.col("endpoint")
    )
    attrs = ready.select("dataset_id", global_attrs(given, format_iso(F.current_timestamp())).alias("attrs"))
    no_attrs = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = ready.select("dataset_id", F.col("vars").alias("var"), variable_attrs(F.col("vars"), no_attrs).alias("attrs"))
    var_attrs = own.unionByName(coordinate_attrs(ready))
    write_grid(grid.withColumn("value", to_fill(F.col("value"))), attrs, var_attrs, path)
    stats = qc_stats(grid)
    write_qc(stats, f"{path}/qc")
    return stats
