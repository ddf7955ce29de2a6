"""Arrow batches inside tasks: slices of bounded size, runs of equal keys, columns as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Text bytes handled at once; numpy needs some fifty times as much for a moment.
SLICE_BYTES = 1 << 19


def byte_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in one array, and the bounds of its rows; NULL counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``text``, or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, bounds = byte_parts(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def longs(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A non-null integer column as int64."""
    return np.asarray(batch.column(batch.schema.get_field_index(name)).cast(pa.int64()))


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def key_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each key of batches sorted by integer ``keys``, as one table per key."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [longs(batch, k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        starts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for first, last in zip(starts, starts[1:]):
            key = tuple(int(c[first]) for c in columns)
            if key != held_key and held:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held)


def _changes(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a key begins; the first one counts."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for name in keys:
        column = np.asarray(batch.column(name).cast(pa.int64()))
        change[1:] |= column[1:] != column[:-1]
    return change


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by integer ``keys`` as tables of about ``rows`` rows or a key's, with the bounds of the keys in them.

    No key is parted, and one that is longer than ``rows`` is a table of its own length.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, np.append(np.flatnonzero(_changes(table, keys)), table.num_rows)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table, bounds = whole(held)
            last = int(bounds[-2])
            if last:
                yield table.slice(0, last), bounds[:-1]
            held = table.slice(last).to_batches()
            size = table.num_rows - last
    if held:
        yield whole(held)


def per_key(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to the rows of every key, one key at a time, streaming through a sorted partition."""

    def run(batches):
        for table in key_runs(batches, keys):
            out = work(table)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
