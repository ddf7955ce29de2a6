"""Centroid clustering of whole-number vectors by scalar lookup tables.

Components become whole numbers, so a dimension holds few different values. Each round tabulates, for every dimension,
the squared difference between each value that occurs and each centroid; the distances of a slice of vectors are then
gathers from these tables and their sums, without a multiplication per vector. Tasks add up what they assign, and only
counts and sums per centroid and dimension leave them, so neither many vectors nor one very full cluster meets in a task.
All arithmetic is in whole numbers: results do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import list_column
from gridloom.shared import materialise

#: Vectors whose distances are gathered together.
SLICE = 4096
#: Whole numbers beyond this on either side are held at it, so that a distance fits into 64 bits.
LARGEST = 1 << 27


def _whole_numbers(dims: int, scale: int):
    """Task function: vectors of ``dims`` finite components as whole numbers; all others go."""

    def work(batches):
        for batch in batches:
            column = batch.column("vector")
            bounds = np.asarray(column.offsets)
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            fits = np.flatnonzero((np.diff(bounds) == dims) & ~np.asarray(column.is_null()))
            parts = flat[bounds[fits][:, None] + np.arange(dims)]
            # A NULL component has become NaN.
            finite = np.isfinite(parts).all(axis=1)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(parts[finite] * scale), -LARGEST, LARGEST).astype(np.int32)
            keep = batch.column("vec_id").take(pa.array(fits[finite]))
            yield pa.RecordBatch.from_arrays([keep, list_column(whole.ravel(), np.arange(len(whole) + 1) * dims, pa.int32())], ["vec_id", "v"])

    return work


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256, column: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vectors of exactly ``dims`` finite components, each component ``floor(scale * x)``."""
    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    return narrow.mapInArrow(_whole_numbers(dims, scale), "vec_id long, v array<int>")


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid number, squared distance) of each row; the smaller number wins a tie."""
    total = np.zeros((len(vectors), len(centroids)), np.int64)
    for d in range(vectors.shape[1]):
        values, place = np.unique(vectors[:, d], return_inverse=True)
        table = (values.astype(np.int64)[:, None] - centroids[None, :, d]) ** 2
        total += table[place]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def _slices(batches, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            part = batch.slice(first, SLICE)
            yield part, _matrix(part.column("v"), dims)


def _sums(centroids: np.ndarray):
    """Task function: count and componentwise sums of what the task assigns to each centroid."""
    k, dims = centroids.shape

    def work(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, vectors in _slices(batches, dims):
            cluster, _ = nearest(vectors, centroids)
            counts += np.bincount(cluster, minlength=k)
            # Exact in doubles: a slice's sums stay below 2 ** 53.
            member = (cluster[None, :] == np.arange(k)[:, None]).astype(np.float64)
            sums += (member @ vectors.astype(np.float64)).astype(np.int64)
        held = np.flatnonzero(counts)
        if len(held):
            flat = list_column(sums[held].ravel(), np.arange(len(held) + 1) * dims, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held]), flat], ["cluster", "n", "sums"])

    return work


def _assigned(centroids: np.ndarray):
    def work(batches):
        for part, vectors in _slices(batches, centroids.shape[1]):
            cluster, distance = nearest(vectors, centroids)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return work


def start_order(seed: int) -> Column:
    """Order in which vectors become the first centroids; a NULL id hashes as an empty one."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def fit_centroids(whole: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of ``whole(vec_id, v)`` after ``rounds`` rounds, as a matrix of whole numbers.

    The driver holds ``k`` vectors, and ``k`` rows of sums a round; a round reads the vectors once.
    """
    first = whole.orderBy(start_order(seed), "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds if len(first) else 0):
        partial = whole.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        parts = partial.select("cluster", "n", F.posexplode("sums").alias("d", "x"))
        totals = parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        for r in totals:
            centroids[r["cluster"], r["d"]] = r["x"] // r["n"]
    return centroids


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, column: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256`` of every vector that is kept.

    ``vectors(vec_id, <column>)`` keeps rows of exactly ``dims`` components, none NULL or not finite; a NULL vector goes.
    Components become ``floor(scale * x)``, held within ``LARGEST``. The first centroids are the ``k`` vectors of the
    smallest SHA-256 of ``<seed>:<vec_id>`` in that order, fewer if there are fewer; rows of one id follow the order of
    their components, a NULL id hashes as an empty one. Each of ``rounds`` rounds assigns every vector to the nearest
    centroid (the smaller number wins a tie) and moves every centroid that has vectors to their floored mean; then vectors
    are assigned once more. Repeated rows count as often as they come; sums beyond 64 bits are NULL; other columns are
    ignored; an empty table gives an empty result.
    """
    whole = materialise(whole_vectors(vectors, dims, scale, column), "whole-vectors")
    centroids = fit_centroids(whole, k, rounds, seed)
    schema = "vec_id long, cluster int, distance long"
    if len(centroids) == 0:
        assigned = whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        assigned = materialise(whole.mapInArrow(_assigned(centroids), schema), "nearest-centroids")
    # One row per centroid: k rows reach the driver and go back as a table.
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(inertia.values())
    rows = [(c, str(d), str(total), centroids[c].tolist(), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    known = whole.sparkSession.createDataFrame(rows, "_c int, _own string, _all string, centroid array<long>, centroid_sha256 string")
    return assigned.join(known, assigned["cluster"] == known["_c"]).select(
        "vec_id", "cluster", "distance", F.col("_own").try_cast("long").alias("cluster_inertia"), F.col("_all").try_cast("long").alias("inertia"),
        "centroid", "centroid_sha256",
    )
