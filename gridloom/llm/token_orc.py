"""Token ids in ORC files: ascending document ids, run-length coded integers, row indexes and Bloom filters.

Files are written in ranges of ``doc_id``, so stripe and row-group statistics prune by id, and Bloom filters tell whether
a stripe can hold one at all. Every stripe is read on its own. ``start`` is not stored per row, since it would have to
wait for all earlier documents: a row knows its place in its file, and the files' totals give the rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.batches import list_column, text_slices
from gridloom.llm.tokens import encoder
from gridloom.shared import materialise

STORED = "doc_id long, file int, place long, n_tokens int, ids array<int>"


def _encoded(vocabulary: str, end_id: int):
    def work(batches):
        encode, end = encoder(vocabulary).encode, end_id.to_bytes(4, "little")
        file, place = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches, "text"):
            parts = [encode(t or "") + end for t in batch.column("text").to_pylist()]
            counts = np.array([len(p) // 4 for p in parts], np.int64)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            ids = np.frombuffer(b"".join(parts), "<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.full(len(parts), file, np.int32)), pa.array(place + bounds[:-1]),
                    pa.array(counts.astype(np.int32)), list_column(ids, bounds, pa.int32()),
                ],
                ["doc_id", "file", "place", "n_tokens", "ids"],
            )
            place += int(bounds[-1])

    return work


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, stripe_bytes: int = 16 << 20) -> None:
    """Encode ``docs(doc_id, text)`` and write the ids, each document closed by ``end_id``, as ORC under ``path``.

    A NULL or empty text is its end id alone. Rows with a NULL ``doc_id`` come first; repeated rows stay, side by side.
    Other columns of ``docs`` are ignored; an empty table writes no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    encoded = ordered.mapInArrow(_encoded(vocabulary, end_id), STORED)
    options = {
        "compression": "zstd", "orc.stripe.size": str(stripe_bytes), "orc.create.index": "true", "orc.row.index.stride": "1000",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }
    encoded.write.options(**options).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; a filter on ``doc_id`` set on the result is pushed to the files."""
    stored = spark.read.schema(STORED).orc(path)
    totals = stored.groupBy("file").agg(F.max(F.col("place") + F.col("n_tokens")).alias("_total"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file; written down, its size is known and the ids are not moved for the join.
    offsets = materialise(totals.select("file", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")), "file-offsets")
    joined = stored.join(offsets, "file")
    return joined.select("doc_id", (F.col("place") + F.col("_offset")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of ``read_token_ids``' rows: CRC-32 of the ids as little-endian bytes."""

    def work(batches):
        for batch in batches:
            column = batch.column("ids")
            bounds, flat = np.asarray(column.offsets), np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), "<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
