"""Row numbers that stay distributed when one key holds a large share of the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import materialise


def differs(now: pa.Array, before: pa.Array) -> np.ndarray:
    """Whether neighbours differ; NULL equals NULL and NaN equals NaN."""
    other = pc.fill_null(pc.not_equal(now, before), False)
    if pa.types.is_floating(now.type):
        other = pc.and_(other, pc.invert(pc.and_(pc.fill_null(pc.is_nan(now), False), pc.fill_null(pc.is_nan(before), False))))
    return np.asarray(other) | (np.asarray(now.is_null()) != np.asarray(before.is_null()))


def _numbered(keys: list[str]):
    """Task function: each row's number in its run of equal keys within the piece, and whether that is the piece's first run."""

    def work(batches):
        piece, last, run, first_run, place = TaskContext.get().partitionId(), None, 0, True, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            fresh = np.zeros(n, bool)
            for k in keys:
                column = batch.column(k)
                fresh[1:] |= differs(column.slice(1), column.slice(0, n - 1))
                if last is not None:
                    fresh[0] |= bool(differs(column.slice(0, 1), last[k])[0])
            at = np.arange(n)
            starts = np.where(fresh, at, -1)
            starts = np.maximum.accumulate(starts)
            number = np.where(starts >= 0, at - starts + 1, at + run + 1)
            in_first = (np.cumsum(fresh) == 0) & first_run
            rest = [c for c in batch.schema.names if c not in keys]
            columns = [batch.column(c) for c in rest]
            added = [pa.array(np.full(n, piece, np.int64)), pa.array(place + at), pa.array(number.astype(np.int64)), pa.array(in_first)]
            yield pa.RecordBatch.from_arrays([*columns, *[batch.column(k) for k in keys], *added], [*rest, *keys, "_piece", "_place", "_number", "_first"])
            run, first_run, place = int(number[-1]), bool(in_first[-1]), place + n
            last = {k: batch.column(k).slice(n - 1, 1) for k in keys}

    return work


def carries(edges: DataFrame) -> DataFrame:
    """``_piece, _carry``: rows of a piece's first run in the pieces before it, from one row per piece.

    ``edges(_piece, _head, _tail, _rows, _whole)`` are the first and last key, the rows of the last run, and whether the piece
    is one run. An exclusive scan along the pieces: a run goes on through pieces that are nothing else.
    """
    line = Window.partitionBy(F.lit(0)).orderBy("_piece")
    goes_on = F.coalesce(F.col("_head").eqNullSafe(F.lag("_tail").over(line)) & F.lag(F.lit(True)).over(line), F.lit(False))
    told = edges.withColumn("_on", goes_on)
    chain = told.withColumn("_chain", F.sum((~(F.col("_on") & F.col("_whole"))).cast("long")).over(line))
    along = Window.partitionBy("_chain").orderBy("_piece")
    summed = chain.withColumn("_held", F.sum("_rows").over(along))
    return summed.select("_piece", F.when(F.col("_on"), F.lag("_held").over(line)).otherwise(F.lit(0)).cast("long").alias("_carry"))


def row_number_by(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based row number within ``keys`` along ``order``, without bringing all rows of a key together.

    The table is range-partitioned on the whole sort key, which splits a large key as well; end ``order`` with a column that
    tells rows apart, since equal sort keys stay together. Rows are numbered inside the sorted pieces, and only the
    run that crosses a piece's lower edge is corrected, by one number per piece. The pieces are written down, because
    their bounds come from a sample and all later stages must see the same ones.
    """
    names = [f"_key_{n}" for n in range(len(keys))]
    flat = [F.to_json(F.struct(k)) if df.schema[k].dataType.simpleString().startswith(("struct", "array", "map")) else F.col(k) for k in keys]
    keyed = df.select(*df.columns, *[c.alias(n) for c, n in zip(flat, names)])
    ordered = keyed.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = keyed.schema.add("_piece", "long").add("_place", "long").add("_number", "long").add("_first", "boolean")
    pieces = materialise(ordered.mapInArrow(_numbered(names), schema), "ordered")
    key = F.struct(F.lit(0).alias("_"), *names)
    ends = pieces.groupBy("_piece").agg(
        F.min_by(key, "_place").alias("_head"), F.max_by(key, "_place").alias("_tail"),
        F.max_by("_number", "_place").alias("_rows"), F.max_by("_first", "_place").alias("_whole"),
    )
    shifts = materialise(carries(ends), "piece-carries")
    joined = pieces.join(shifts, "_piece")
    number: Column = F.col("_number") + F.when(F.col("_first"), F.col("_carry")).otherwise(0)
    return joined.select(*df.columns, number.alias(out))
