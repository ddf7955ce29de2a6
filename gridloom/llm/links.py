"""Similar pairs found in buckets, kept linear in the rows: spanning edges per bucket, link counts per component.

Pairs are never written. A bucket gives a spanning forest of its links; forests of all buckets give the components; each
component then counts the links of its members. Buckets and components beyond ``block`` rows are cut into blocks, and
every pair of blocks becomes a task of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import longs, per_key, whole_runs

#: Rows of a bucket or component that one task compares at once; a pair of blocks holds twice as many.
BLOCK = 1024
#: Rows of a bucket whose pairs are compared along with those of other buckets, and rows compared together.
SMALL, TOGETHER = 12, 1 << 15


def block_pairs(rows: DataFrame, key: str, member: str, block: int = BLOCK, own: bool = False) -> DataFrame:
    """``rows`` of every ``key`` held by two or more, placed into pairs of blocks ``_i <= _j``; ``_k`` is the row's block.

    A key of up to ``block`` rows is the one pair (0, 0). ``own`` also makes the pair of each block with itself, which
    a forest does not need, since any other pair holds the block's inner links.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    placed = rows.join(sizes, key).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    placed = placed.withColumn("_k", F.pmod(F.xxhash64(member), F.col("_blocks").cast("long")).cast("int"))
    inner = F.lit(own) | (F.col("_blocks") == 1)
    others = F.filter(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda x: inner | (x != F.col("_k")))
    paired = placed.withColumn("_other", F.explode(others))
    return paired.withColumn("_i", F.least("_k", "_other")).withColumn("_j", F.greatest("_k", "_other")).drop("_other", "_n", "_blocks")


def spanning(n: int, similar: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of rows 0..n-1; ``similar(i, candidates)`` tells which candidates are linked with row i.

    Breadth first over the rows not reached yet, so a group of near copies is done in one step.
    """
    left = np.arange(n)
    edges: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = similar(at, left)
            found = left[hit].tolist()
            left = left[~hit]
            edges += [(at, other) for other in found]
            queue += found
    return edges


def _forest(ids: np.ndarray, starts: np.ndarray, similar: Callable[[int | np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Edges of many buckets: all links of the small ones, a spanning forest of each larger one.

    Bucket k is the rows from ``starts[k]`` to ``starts[k + 1]``. Rows of small buckets are compared with the first, second and
    so on after them, all buckets at once.
    """
    sizes = np.diff(starts)
    bucket_end = np.repeat(starts[1:], sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    rows, edges = np.arange(len(ids)), []
    for step in range(1, min(SMALL, int(sizes.max(initial=0)))):
        first = rows[small & (rows + step < bucket_end)]
        first = first[similar(first, first + step)]
        edges.append(np.stack([ids[first], ids[first + step]], axis=1))
    for begin, size in zip(starts[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        found = spanning(size, lambda k, others: similar(begin + k, begin + others))  # noqa: B023
        edges.append(ids[begin + np.array(found, np.int64).reshape(-1, 2)])
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def forests(rows: DataFrame, bucket: str, member: str, prepare: Callable[[pa.Table], Callable[[int | np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """Edges ``(u, v)`` that connect what is linked within the buckets; ``prepare(table)`` gives ``similar``.

    ``similar(i, others)`` compares row ``i`` with each of the others, or rows pairwise if ``i`` is an array of them.
    """
    keys = [bucket, "_i", "_j"]

    def work(batches):
        for table, starts in whole_runs(batches, keys, TOGETHER):
            edges = _forest(longs(table, member), starts, prepare(table))
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    paired = block_pairs(rows, bucket, member).repartition(*keys).sortWithinPartitions(*keys)
    return paired.mapInArrow(work, "u long, v long").where("u <> v").distinct()


def degrees(rows: DataFrame, key: str, member: str, weight: str, linked: Callable[[pa.Table], np.ndarray], block: int = BLOCK) -> DataFrame:
    """Weighted links of each member inside its ``key``, and edges that connect them: ``(id, u, v, n)``.

    ``linked(table)`` gives the boolean matrix of a pair of blocks. Rows with ``id`` carry a part of its count ``n``, rows
    with ``u, v`` an edge; members without a link may be absent.
    """

    def work(table: pa.Table):
        if table.num_rows < 2:
            return None
        whole = table.combine_chunks()
        ids, weights, blocks = (longs(whole, c) for c in (member, weight, "_k"))
        matrix = linked(whole)
        np.fill_diagonal(matrix, False)
        if blocks.min() != blocks.max():
            counted = matrix & (blocks[:, None] != blocks[None, :])
        elif longs(whole, "_i")[0] == longs(whole, "_j")[0]:
            counted = matrix
        else:
            return None
        counts = counted @ weights
        edges = np.array(spanning(len(ids), lambda i, c: matrix[i, c]), np.int64).reshape(-1, 2)
        has = np.flatnonzero(counts)
        nothing = lambda n: pa.nulls(n, pa.int64())
        columns = [
            pa.chunked_array([pa.array(ids[has]), nothing(len(edges))]),
            pa.chunked_array([nothing(len(has)), pa.array(ids[edges[:, 0]])]),
            pa.chunked_array([nothing(len(has)), pa.array(ids[edges[:, 1]])]),
            pa.chunked_array([pa.array(counts[has].astype(np.int64)), nothing(len(edges))]),
        ]
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], ["id", "u", "v", "n"])

    paired = block_pairs(rows, key, member, block, own=True)
    return per_key(paired, [key, "_i", "_j"], work, "id long, u long, v long, n long")
