"""Packing of token ids into windows by best-fit decreasing.

Documents beyond a window are first cut into full windows; what remains of each document is placed, longest first, into
the open window it leaves least room in. A segment tree over the remaining capacities finds that window. Packing runs in
place, where a partition's documents are encoded, over a few thousand windows at a time: nothing is shuffled, memory is
bounded, and of each such lot only the last windows stay partly empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import text_slices
from gridloom.llm.tokens import REMEMBERED, encoder

#: Tokens packed together; some thousand windows of 4096.
LOT = 1 << 22

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Capacities:
    """Open windows by remaining capacity, under a segment tree of their numbers."""

    def __init__(self, window: int) -> None:
        self.base = 1 << window.bit_length()
        self.counts = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = self.base + capacity
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for ``least``."""
        counts, node = self.counts, self.base + least
        if not counts[node]:
            # Up to the first right-hand neighbour that holds a window, then down its left-most way.
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node <<= 1
                if not counts[node]:
                    node += 1
        capacity = node - self.base
        while node:
            counts[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each length, none over ``window``; window numbers are gapless from 0."""
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, used = Capacities(window), 0
    for at in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        length = lengths[at]
        found = tree.take(length) if length < window else None
        if found is None:
            found, used = (window, used), used + 1
        capacity, number = found
        places[at] = (number, window - capacity)
        if capacity > length:
            tree.put(capacity - length, number)
    return places


def _packed(vocabulary: str, end_id: int, window: int, lot: int, remember: int):
    def work(batches):
        encode, end = encoder(vocabulary, remember).encode, end_id.to_bytes(4, "little")
        first_sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, bytes, int]] = []
        tokens = 0

        def flush():
            nonlocal first_sequence
            places = best_fit_decreasing([len(p[2]) // 4 for p in held], window)
            columns = list(zip(*held))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([len(b) // 4 for b in columns[2]], pa.int64()),
                    pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64()),
                    pa.array([first_sequence + p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            first_sequence += 1 + max(p[0] for p in places)
            held.clear()
            return out

        for batch in text_slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                held += [(doc, at, ids[4 * at : 4 * (at + window)], total) for at in range(0, total, window)]
                tokens += total
                if tokens >= lot:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return work


def packed(docs: DataFrame, vocabulary: str, end_id: int, window: int = 4096, lot: int = LOT, remember: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``docs(doc_id, text)`` is encoded whole, ``end_id`` closes each document, so a NULL or empty text is one piece of one
    id; other columns are ignored, and repeated rows are packed as often as they come. ``ids`` holds little-endian
    unsigned 32-bit ids; ``start`` counts the document's ids before the piece, ``offset`` those of the sequence. Each
    sequence has at most ``window`` ids; the caller pads. An empty table gives no pieces. ``remember`` bounds the bytes of words
    and ids that a worker keeps; it changes speed and memory only.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_packed(vocabulary, end_id, window, lot, remember), PIECES)
