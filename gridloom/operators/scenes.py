"""Functions over the 2-D arrays of scenes, block by block with a halo of neighbouring pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What tells scenes apart.
SCENE = ("dataset_id", "part", "scene_id")
#: Array cells handled together.
CELLS = 1 << 20


def _blocks_of(place: str, block: int, halo: int) -> Column:
    """Numbers of the blocks along one axis that a pixel belongs to or lies next to."""
    return F.sequence(F.floor((F.col(place) - halo) / block), F.floor((F.col(place) + halo) / block))


def _array_task(function, bands: list[str], out: list[str], kept: list[str], block: int, halo: int):
    """Task function: sorted pixels of many blocks to stacks of arrays, through ``function``, and back to pixels."""
    side = block + 2 * halo
    stack = max(1, CELLS // (side * side))

    def solve(rows: pa.Table, number: np.ndarray) -> pa.RecordBatch:
        n = int(number[-1]) + 1
        at = [np.asarray(rows[c]) for c in ("row", "col", "_block_row", "_block_col")]
        down, right = at[0] - at[2] * block + halo, at[1] - at[3] * block + halo
        arrays = {}
        for band in bands:
            arrays[band] = np.full((n, side, side), np.nan)
            arrays[band][number, down, right] = rows[band].to_numpy().astype(np.float64)
        made = function(arrays)
        own = (down >= halo) & (down < halo + block) & (right >= halo) & (right < halo + block)
        number, down, right = number[own], down[own], right[own]
        inner = rows.select(kept).filter(pa.array(own)).combine_chunks()
        values = [pa.array(v, from_pandas=True) for v in (np.asarray(made[c], np.float64)[number, down, right] for c in out)]
        columns = [inner[c].combine_chunks() if inner.num_rows else pa.array([], inner.schema.field(c).type) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, *values], [*kept, *out])

    def work(batches):
        held, blocks, last = [], 0, None
        numbers: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = np.asarray(batch.column("_block"))
            first = 0
            fresh = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            while first < len(key):
                # As many whole blocks as a stack takes; a block may go on in the next batch.
                counted = blocks + np.cumsum(fresh[first:])
                end = first + int(np.searchsorted(counted, stack, side="right"))
                if end > first:
                    held.append(batch.slice(first, end - first))
                    numbers.append(counted[: end - first] - 1)
                    blocks = int(counted[end - first - 1])
                if end < len(key):
                    yield solve(pa.Table.from_batches(held), np.concatenate(numbers))
                    held, numbers, blocks = [], [], 0
                first = end
            last = key[-1]
        if held:
            yield solve(pa.Table.from_batches(held), np.concatenate(numbers))

    return work


def map_arrays(
    px: DataFrame, bands: list[str], function: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out: list[str],
    halo: int = 0, block: int = 256, keys: tuple[str, ...] = SCENE,
) -> DataFrame:
    """Apply a function of 2-D arrays to every scene: ``(*keys, row, col, *out)``, one row per pixel that is there.

    Scenes are cut into square blocks, and pixels near a block's edge also go to its neighbours, so a block sees ``halo``
    pixels beyond its edges and no task ever holds a scene. ``function`` gets an array per band, of shape (blocks, rows, columns), NaN
    where a pixel is masked or absent, and returns arrays of the same shape, one per name in ``out``; a NaN becomes NULL. It must
    look no further than ``halo`` pixels. Repeated observations of a pixel are averaged first.
    """
    once = px.groupBy(*keys, "row", "col").agg(*[F.avg(b).alias(b) for b in bands])
    rows = once.withColumn("_block_row", F.explode(_blocks_of("row", block, halo)))
    rows = rows.withColumn("_block_col", F.explode(_blocks_of("col", block, halo)))
    # Blocks are told apart by a hash in the task, where only neighbours in sorted order are compared.
    sort = [*keys, "_block_row", "_block_col"]
    rows = rows.withColumn("_block", F.xxhash64(*sort)).repartition(*sort).sortWithinPartitions(*sort)
    kept = [*keys, "row", "col"]
    kinds = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in once.select(*kept).schema], *[f"{c} double" for c in out]])
    return rows.mapInArrow(_array_task(function, bands, out, kept, block, halo), kinds)
