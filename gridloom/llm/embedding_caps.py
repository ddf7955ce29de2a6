"""Near-duplicate embeddings by spherical-cap filters drawn from structured random product codes.

A random rotation is cut into ``blocks`` coordinate blocks, each with its own random code of unit vectors. A filter
direction is one code word per block, so ``words ** blocks`` directions cost only ``blocks * words`` products. A vector
is list-decoded to all directions whose inner product exceeds a threshold: code words of the blocks are combined best
first, and a partial sum goes on only if the best words of the remaining blocks can still lift it over the threshold.
Vectors that share a filter are compared on bytes, with the most that rounding can hide allowed for; what that connects
is compared exactly, in double precision.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import binary_column, longs
from gridloom.llm.components import components
from gridloom.llm.links import degrees, forests
from gridloom.llm.words import mix
from gridloom.shared import materialise

#: Filters an average random vector passes. Near the threshold of 0.93 a pair shares about half of them.
HITS = 40


class ProductCode:
    """Directions made of one random code word per coordinate block; ids run over all combinations."""

    def __init__(self, dim: int, rows: int, hits: int = HITS, seed: int = 11) -> None:
        self.blocks = max(1, min(3, dim))
        # The filters grow with the rows, so that a bucket of unrelated vectors stays as small.
        wanted = max(64 * hits, rows * hits // 32)
        # A line has two directions only.
        self.words = 2 if dim == 1 else max(4, math.ceil(wanted ** (1 / self.blocks)))
        random = np.random.default_rng([seed, dim])
        self.rotation = np.linalg.qr(random.normal(size=(dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            code = random.normal(size=(self.words, b - a))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True))
        share = min(0.5, hits / self.words**self.blocks)
        # An inner product of a random unit vector is about normal; code words are unit per block.
        spread = math.sqrt(self.blocks / dim)
        self.threshold = NormalDist().inv_cdf(1 - share) * spread
        # The products of two vectors at a cosine of 0.93 differ by 0.37 spreads on average (squared mean).
        self.margin = 0.75 * spread

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every direction over the threshold, and of those within ``margin`` of the row's best one.

        The latter serves rows whose best direction is hardly over the threshold, or below it.
        """
        turned = vectors @ self.rotation
        scores = [turned[:, a:b] @ code.T for a, b, code in zip(self.cuts, self.cuts[1:], self.codes)]
        best = [s.max(axis=1) for s in scores]
        rest = np.array([sum(best[k + 1 :], np.zeros(len(vectors))) for k in range(self.blocks)])
        goal = np.minimum(self.threshold, sum(best) - self.margin)
        row, part, total = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for k, score in enumerate(scores):
            reach = total[:, None] + score[row]
            at, word = np.nonzero(reach + rest[k][row][:, None] >= goal[row][:, None])
            row, part, total = row[at], part[at] * self.words + word, reach[at, word]
        return row, part


def _usable(column: str) -> F.Column:
    """Neither NULL nor holding a NULL or non-finite component, and not zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def near_embeddings(vectors: DataFrame, threshold: float = 0.93, hits: int = HITS) -> DataFrame:
    """Links between vectors of one label whose cosine is ``threshold`` or more.

    Takes ``vec_id, embedding array<float|double>, label`` (other columns are ignored) and returns ``vec_id, n_links,
    component_id, kept`` per row. A vector that is NULL, zero or holds a NULL or non-finite component, a NULL label and a
    NULL ``vec_id`` link with nothing: no links, own component. Vectors of different lengths never link. Equal vectors
    of a label are one node with a weight; repeated rows of an id count as one more copy each. An empty table gives an
    empty result.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("_label"))
    fit = rows.where(_usable("vector") & F.col("_label").isNotNull() & F.col("vec_id").isNotNull())
    keyed = fit.withColumn("_copy", F.md5(F.concat_ws("|", F.to_json(F.struct("_label")), F.array_join(F.col("vector").cast("array<string>"), ","))))
    classes = keyed.groupBy("_copy").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"), F.first("_label").alias("_label")
    )
    # An id may have several vectors, so nodes are told apart by their copies' hash.
    classes = materialise(classes.withColumn("id", F.xxhash64("_copy")), "vectors").withColumn("_dim", F.size("vector")).withColumn("_kind", F.xxhash64("_dim", "_label"))
    shapes = classes.groupBy("_dim", "_kind").agg(F.count("*").alias("n"))
    # One row per vector length: how many of them the largest label holds.
    largest = {r["_dim"]: r["n"] for r in shapes.groupBy("_dim").agg(F.max("n").alias("n")).collect()}

    def filters(batches):
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            dims = longs(batch, "_dim")
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                code = codes.setdefault(int(dim), ProductCode(int(dim), largest[int(dim)], hits))
                for first in range(0, part.num_rows, 256):
                    piece = part.slice(first, 256)
                    matrix = _matrix(piece.column("vector"))
                    row, found = code.decode(matrix)
                    kind = longs(piece, "_kind").view(np.uint64)
                    bucket = mix(kind[row] ^ mix(found.astype(np.uint64))).view(np.int64)
                    step = np.abs(matrix).max(axis=1) / 127
                    small = binary_column([v.tobytes() for v in np.rint(matrix / step[:, None]).astype(np.int8)])
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), piece.column("id").take(at), small.take(at), pa.array(step[row])], ["bucket", "id", "small", "step"])

    placed = classes.select("id", "vector", "_kind", F.col("_dim").cast("long").alias("_dim")).mapInArrow(filters, "bucket long, id long, small binary, step double")

    def rounded(table: pa.Table):
        parts = table.column("small").to_pylist()
        wide = max(map(len, parts))
        # Bucket keys are hashes: should vectors of other lengths meet, they are padded; the exact check parts them.
        matrix = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in parts), np.int8).reshape(len(parts), -1).astype(np.float32)
        step = np.asarray(table.column("step"))
        matrix *= step.astype(np.float32)[:, None]
        # Most that rounding can have moved a vector.
        off = step * (0.5 * math.sqrt(wide)) + 1e-6

        def similar(i: int | np.ndarray, others: np.ndarray) -> np.ndarray:
            cosine = matrix[others] @ matrix[i] if np.ndim(i) == 0 else np.einsum("ij,ij->i", matrix[others], matrix[i])
            return cosine >= threshold - off[i] - off[others] - off[i] * off[others]

        return similar

    near = materialise(components(forests(placed, "bucket", "id", rounded)), "cap-candidates")

    def linked(table: pa.Table) -> np.ndarray:
        kinds = longs(table, "_kind")
        matrix = np.zeros((len(kinds), len(kinds)), bool)
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            unit = _matrix(table.column("vector").combine_chunks().take(pa.array(at)))
            matrix[np.ix_(at, at)] = unit @ unit.T >= threshold
        return matrix

    inside = near.join(classes.select("id", "weight", "vector", "_kind"), "id")
    links = materialise(degrees(inside, "component", "id", "weight", linked), "cap-links")
    found = components(links.where("u is not null").select("u", "v"))
    groups = materialise(found.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("group")), "cap-groups")
    grouped = found.join(groups, "component").select("id", "group")
    counted = links.where("id is not null")
    counts = counted.groupBy("id").agg(F.sum("n").alias("n"))
    per_class = (
        classes.select("_copy", "id", "least", "weight").join(counts, "id", "left").join(grouped, "id", "left")
        .select("_copy", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("_links"), F.coalesce("group", "least").alias("_component"))
    )
    linked_rows = keyed.select("vec_id", "_copy").join(per_class, "_copy").select("vec_id", "_links", "_component")
    alone = rows.where(~F.coalesce(_usable("vector") & F.col("_label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    every = linked_rows.union(alone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return every.select(
        "vec_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("_component"), F.lit(True)).alias("kept"),
    )
