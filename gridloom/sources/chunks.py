"""Grids stored as chunked arrays: dense blocks of cells as binary columns, found by their chunk numbers.

An axis is its sorted distinct coordinates, and a chunk the cells of up to ``side`` neighbouring coordinates on every axis. A
chunk row holds its coordinates, so it is decoded by itself, and the least and greatest of each, so that a window is
a filter on columns that Parquet prunes by. Cells that come more than once are beside the array in lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.axes import CHUNK_SIDE
from gridloom.operators.composites import grid_keys
from gridloom.operators.medians import null_safe
from gridloom.operators.skew import differs
from gridloom.shared import materialise

AXES = ("time", "y", "x")
#: Repeated cells in one list.
LIST = 1 << 16
_CHUNK = ", ".join(f"c_{a} int, n_{a} int" for a in AXES)
_ENCODED = f"_series long, {_CHUNK}, dense boolean, cells binary, state binary, data binary"
#: Bits of a chunk's extent along an axis, of three in one number.
_BITS = 20
ABSENT, MASKED, VALUE = 0, 1, 2


def axis_tables(grid: DataFrame, side: int = CHUNK_SIDE) -> dict[str, DataFrame]:
    """Per axis the coordinates of each dataset with their index, chunk and place in it; NULL is a coordinate, the first one."""
    keys = grid_keys(grid)
    tables = {}
    for axis in AXES:
        known = grid.select(*keys, F.col(axis)).distinct() if axis in grid.columns else grid.select(*keys, F.lit(None).cast("date").alias(axis)).distinct()
        index = F.row_number().over(Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(axis)) - 1
        placed = known.withColumn("_index", index)
        placed = placed.select(*keys, axis, F.floor(F.col("_index") / side).cast("int").alias(f"c_{axis}"), (F.col("_index") % side).cast("int").alias(f"p_{axis}"))
        tables[axis] = materialise(placed, f"axis-{axis}")
    return tables


def _encoded():
    """Task function: cells, chunk after chunk, to a row with the array of each, and rows of what comes more than once.

    A chunk that comes in several parts, as one with many cells does, has several such rows.
    """
    extents = [f"n_{a}" for a in AXES]
    chunk = ["_series", *[f"c_{a}" for a in AXES]]
    names = [part.split()[0] for part in _ENCODED.split(", ")]

    def rows_of(head: dict, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        shape = tuple(head[e] for e in extents)
        cell = np.concatenate([p[0] for p in parts])
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        value, null = np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order]
        state = np.where(null, MASKED, VALUE).astype(np.uint8)
        first = np.concatenate([[True], cell[1:] != cell[:-1]])
        states, data = np.zeros(int(np.prod(shape)), np.uint8), np.zeros(int(np.prod(shape)))
        states[cell[first]], data[cell[first]] = state[first], np.where(null[first], 0.0, value[first])
        yield {**head, "dense": True, "cells": None, "state": states.tobytes(), "data": data.tobytes()}
        again = np.flatnonzero(~first)
        if len(again):
            yield {**head, "dense": False, "cells": cell[again].astype("<i4").tobytes(), "state": state[again].tobytes(), "data": np.where(null[again], 0.0, value[again]).tobytes()}

    def work(batches):
        out, head, parts, size, schema = [], None, [], 0, None

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            if schema is None:
                fields = [*[batch.schema.field(c) for c in chunk], *[pa.field(e, pa.int32()) for e in extents]]
                kinds = [("dense", pa.bool_()), ("cells", pa.binary()), ("state", pa.binary()), ("data", pa.binary())]
                by_name = {f.name: f for f in [*fields, *[pa.field(*k) for k in kinds]]}
                schema = pa.schema([by_name[c] for c in names])
            fresh = np.zeros(batch.num_rows, bool)
            fresh[0] = True
            for c in chunk:
                column = batch.column(c)
                fresh[1:] |= differs(column.slice(1), column.slice(0, batch.num_rows - 1))
            starts = np.flatnonzero(fresh)
            heads = batch.select([*chunk, "_extent"]).take(pa.array(starts)).to_pylist()
            for told in heads:
                packed = told.pop("_extent")
                told.update({e: packed >> _BITS * k & (1 << _BITS) - 1 for k, e in enumerate(extents)})
            cell = np.asarray(batch.column("_cell"))
            value = batch.column("value")
            number, null = value.to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(value.is_null())
            for now, a, b in zip(heads, starts, [*starts[1:], batch.num_rows]):
                # A very often repeated cell does not hold up a chunk: what is held is written when it is enough.
                if head is not None and (now != head or size >= LIST):
                    out += rows_of(head, parts) if parts else []
                    parts, size = [], 0
                    if len(out) >= 64:
                        yield batch_of(out)
                        out = []
                head = now
                parts.append((cell[a:b], number[a:b], null[a:b]))
                size += b - a
        if parts:
            out += rows_of(head, parts)
        if out:
            yield batch_of(out)

    return work


def write_chunks(grid: DataFrame, path: str, side: int = CHUNK_SIDE) -> None:
    """Store long grid rows ``(dataset_id, part, var, time, y, x, value)``, of the first two and time what there is, as chunks.

    Repeated cells and NULL values stay. Chunks are ranged over files by dataset, variable and chunk numbers.
    """
    keys = grid_keys(grid)
    rows = grid if "time" in grid.columns else grid.withColumn("time", F.lit(None).cast("date"))
    # One number stands for dataset and variable while cells are dealt and encoded.
    series = materialise(grid.select(*keys, "var").distinct().withColumn("_series", F.monotonically_increasing_id()), "grid-series")
    rows = rows.join(series, null_safe(rows, series, [*keys, "var"])).select(*[rows[c] for c in rows.columns], "_series")
    tables = axis_tables(grid, side)
    for axis, table in tables.items():
        sized = table.withColumn(f"n_{axis}", F.count("*").over(Window.partitionBy(*keys, f"c_{axis}")).cast("int"))
        rows = rows.join(sized, null_safe(rows, sized, [*keys, axis])).select(*[rows[c] for c in rows.columns], *[sized[f"{k}_{axis}"] for k in ("c", "p", "n")])
    cell = (F.col("p_time") * F.col("n_y") + F.col("p_y")) * F.col("n_x") + F.col("p_x")
    numbers = [f"c_{a}" for a in AXES]
    extent = F.lit(0).cast("long")
    for k, axis in enumerate(AXES):
        extent = extent + F.shiftleft(F.col(f"n_{axis}").cast("long"), _BITS * k)
    placed = rows.select("_series", *numbers, extent.alias("_extent"), cell.cast("int").alias("_cell"), F.col("value").cast("double").alias("value"))
    # Dealt and sorted by one number per chunk: no pass to find ranges, and cells are put in order by the array's task.
    ordered = placed.withColumn("_chunk", F.xxhash64("_series", *numbers)).repartition("_chunk").sortWithinPartitions("_chunk").drop("_chunk")
    encoded = materialise(ordered.mapInArrow(_encoded(), _ENCODED), "grid-chunks")
    encoded = encoded.join(series, "_series").select(*keys, "var", *[c for c in encoded.columns if c != "_series"])
    chunk = [*keys, "var", *numbers]
    for axis, table in tables.items():
        spans = table.groupBy(*keys, f"c_{axis}").agg(
            F.transform(F.sort_array(F.collect_list(F.struct(f"p_{axis}", axis))), lambda s: s[axis]).alias(f"at_{axis}"),
            F.min(axis).alias(f"min_{axis}"), F.max(axis).alias(f"max_{axis}"),
        )
        both = encoded.join(spans, null_safe(encoded, spans, [*keys, f"c_{axis}"]))
        encoded = both.select(*[encoded[c] for c in encoded.columns], *[spans[f"{k}_{axis}"] for k in ("at", "min", "max")])
    encoded.repartitionByRange(*chunk).sortWithinPartitions(*chunk).write.parquet(path, compression="gzip")


def _decoded(columns: list[str]):
    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                shape = [row.column(f"n_{a}")[0].as_py() for a in AXES]
                state = np.frombuffer(row.column("state")[0].as_py(), np.uint8)
                data = np.frombuffer(row.column("data")[0].as_py(), np.float64)
                if row.column("dense")[0].as_py():
                    cell = np.flatnonzero(state != ABSENT)
                    state, data = state[cell], data[cell]
                else:
                    cell = np.frombuffer(row.column("cells")[0].as_py(), "<i4")
                places = np.unravel_index(cell, shape)
                axes = {a: row.column(f"at_{a}")[0].values.take(pa.array(p)) for a, p in zip(AXES, places)}
                zero = pa.array(np.zeros(len(cell), np.int64))
                told = {c: row.column(c).take(zero) for c in columns if c not in (*AXES, "value")}
                value = pa.array(data, mask=state == MASKED)
                yield pa.RecordBatch.from_arrays([axes[c] if c in AXES else value if c == "value" else told[c] for c in columns], columns)

    return work


def read_chunks(spark: SparkSession, path: str, **window: tuple) -> DataFrame:
    """The grid's long rows; ``window`` gives (least, greatest) per axis, and only chunks that can hold such cells are read."""
    stored = spark.read.parquet(path)
    unknown = set(window) - set(AXES)
    if unknown:
        raise ValueError(f"no axis {sorted(unknown)}")
    for axis, (low, high) in window.items():
        stored = stored.where((F.col(f"min_{axis}") <= F.lit(high)) & (F.col(f"max_{axis}") >= F.lit(low)))
    keys = grid_keys(stored)
    columns = [*keys, "var", *AXES, "value"]
    kinds = [f"{c} {stored.schema[f'at_{c}'].dataType.elementType.simpleString() if c in AXES else 'double' if c == 'value' else stored.schema[c].dataType.simpleString()}" for c in columns]
    cells = stored.mapInArrow(_decoded(columns), ", ".join(kinds))
    inside: Column = F.lit(True)
    for axis, (low, high) in window.items():
        inside = inside & F.col(axis).between(F.lit(low), F.lit(high))
    return cells.where(inside)
