"""Jaccard join on word shingles by chosen paths.

In each run every set picks those of its tokens whose hash under the run's function lies below ``GROWTH / |set|``, so a
set goes down about ``GROWTH`` paths and two sets of Jaccard 0.8 share 1.3 of them on average, while sets that share few
tokens part at once. A bucket too large to be compared directly is split again: its sets pick tokens by a new function
that belongs to the path. Buckets are brute-forced on min-wise sketches, what that finds is checked exactly on whole
sets, and the runs are repeated until the recall left open is negligible.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import binary_column, byte_parts, list_column, longs, text_slices
from gridloom.llm.components import components
from gridloom.llm.links import degrees, forests
from gridloom.llm.words import U64, mix, shingle_sets
from gridloom.shared import materialise

#: Expected paths a set goes down per level.
GROWTH = 1.6
#: A bucket of more sets is split once more along its paths.
BUCKET = 256
#: Bytes of a min-wise sketch; at a Jaccard of 0.8 the matching share has a deviation of 0.04.
SKETCH = 96
#: Shortfall of a sketch's estimate that is still compared exactly, in deviations.
SLACK = 4.5

_random = np.random.default_rng(20260202)
_SKETCHES = _random.integers(1, 2**63, SKETCH, dtype=np.uint64) * U64(2) + U64(1)
_SIGNATURE = _random.integers(1, 2**63, 2, dtype=np.uint64)

#: What tells rows apart: NULL ids come last and count as 0, ``tx`` is the 64-bit hash of the text.
ROW = ["nameless", "doc_id", "tx"]
FEATURES = "nameless long, doc_id long, tx long, sig string, n_shingles long, keys array<long>, children array<array<long>>, sketch binary"


def runs_for(similarity: float, recall: float) -> int:
    """Runs after which a pair just similar enough is missed with a probability below ``1 - recall``.

    The shared paths of such a pair are about Poisson distributed on each of two levels.
    """
    shared = GROWTH * similarity
    once = 1 - math.exp(-shared)
    twice = 1 - math.exp(-shared * once)
    return math.ceil(math.log(1 - recall) / math.log(1 - twice))


def _seed(run: int) -> np.uint64:
    """Seed of a run's first hash function, for any number of runs."""
    return mix(np.array([0xA5A5_0F1E_2D3C_4B5A + 2 * run], np.uint64))[0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _picked(tokens: np.ndarray, seed: np.ndarray, limit: np.ndarray) -> np.ndarray:
    return np.flatnonzero(mix(tokens ^ seed) <= limit)


def _features(runs: int, size: int):
    """Task function: fingerprints, first and second path keys and sketch of every text with words."""

    def work(batches):
        for batch in text_slices(batches, "text", 1 << 19):
            tokens, bounds = shingle_sets(*byte_parts(batch.column("text")), size)
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            if not len(full):
                continue
            rows, starts, counts = [longs(batch, c)[full] for c in ROW], bounds[:-1][full], counts[full]
            sums = [np.add.reduceat(mix(tokens ^ s), starts) for s in _SIGNATURE]
            owner = np.repeat(np.arange(len(full)), counts)
            share = np.minimum(GROWTH / counts, 1.0)
            limit = np.minimum(share * 2.0**64, 2.0**64 - 4096).astype(np.uint64)[owner]
            sketch = np.empty((len(full), SKETCH), np.uint8)
            for k, factor in enumerate(_SKETCHES):
                sketch[:, k] = (mix(np.minimum.reduceat(tokens * factor, starts)) & U64(255)).astype(np.uint8)
            set_of, keys = [], []
            for run in range(runs):
                at = _picked(tokens, _seed(run), limit)
                set_of.append(owner[at])
                keys.append(mix(tokens[at] + _seed(run)))
            set_of, keys = np.concatenate(set_of), np.concatenate(keys)
            order = np.argsort(set_of, kind="stable")
            set_of, keys = set_of[order], keys[order]
            children = []
            for doc, key in zip(set_of.tolist(), keys):
                own = tokens[starts[doc] : starts[doc] + counts[doc]]
                children.append(mix(own[_picked(own, key, limit[starts[doc] - starts[0]])] ^ mix(key[None])[0]))
            child_bounds = np.concatenate([[0], np.cumsum([len(c) for c in children])]).astype(np.int64)
            key_bounds = np.searchsorted(set_of, np.arange(len(full) + 1))
            flat = np.concatenate(children) if children else np.zeros(0, np.uint64)
            lists = list_column(_signed(flat), child_bounds, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *map(pa.array, rows),
                    pa.array([f"{a:016x}{b:016x}{n:x}" for a, b, n in zip(*[s.tolist() for s in sums], counts.tolist())]),
                    pa.array(counts.astype(np.int64)),
                    list_column(_signed(keys), key_bounds, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(key_bounds.astype(np.int32)), lists),
                    binary_column([row.tobytes() for row in sketch]),
                ],
                [*ROW, "sig", "n_shingles", "keys", "children", "sketch"],
            )

    return work


def _leaves(classes: DataFrame) -> DataFrame:
    """(id, bucket) of every path followed to its end, for buckets held by two sets or more."""
    paths = classes.select("id", F.explode(F.arrays_zip("keys", "children")).alias("p")).select("id", "p.keys", "p.children")
    sizes = paths.groupBy("keys").agg(F.count("*").alias("_n")).where("_n > 1")
    ends = F.when(F.col("_n") <= BUCKET, F.array("keys")).otherwise(F.col("children"))
    leaves = paths.join(sizes, "keys").select("id", F.explode(ends).alias("bucket")).distinct()
    held = leaves.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    return leaves.join(held, "bucket").select("id", "bucket")


def _sketch_similar(similarity: float):
    least = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / SKETCH)

    def prepare(table: pa.Table):
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        counts = np.asarray(table.column("n_shingles"))

        def similar(i: int | np.ndarray, others: np.ndarray) -> np.ndarray:
            n, m = counts[i], counts[others]
            near = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6
            own = sketch[i] if np.ndim(i) == 0 else sketch[i[near]]
            near[near] = (sketch[others[near]] == own).mean(axis=1) >= least
            return near

        return similar

    return prepare


def _jaccard(numerator: int, denominator: int):
    """Task function: exact matrix of Jaccard >= numerator / denominator over sorted shingle sets."""

    def linked(table: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(np.concatenate(sets), kind="stable")
        values, owner = np.concatenate(sets)[order], owner[order]
        fresh = np.concatenate([[True], values[1:] != values[:-1]])
        token = np.cumsum(fresh) - 1
        shared = np.bincount(token)[token] > 1
        token, owner = token[shared], owner[shared]
        both = np.zeros((len(sets), len(sets)), np.float32)
        if len(token):
            token = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]).astype(np.int64)]))
            wide = 4096
            for first in range(0, int(token[-1]) + 1, wide):
                a, b = np.searchsorted(token, [first, first + wide])
                part = np.zeros((len(sets), min(wide, int(token[-1]) + 1 - first)), np.float32)
                part[owner[a:b], token[a:b] - first] = 1
                both += part @ part.T
        common = both.astype(np.int64)
        return denominator * common >= numerator * (sizes[:, None] + sizes[None, :] - common)

    return linked


def _row_part(name: str) -> Column:
    """A column of ``ROW`` over ``doc_id, text``."""
    doc_id = F.col("doc_id").cast("long")
    if name == "nameless":
        return doc_id.isNull().cast("long")
    return F.coalesce(doc_id, F.lit(0).cast("long")) if name == "doc_id" else F.xxhash64(F.col("text").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``nameless, doc_id, tx, text`` of every row."""
    return docs.select(*[_row_part(c).alias(c) for c in ROW], F.col("text").cast("string").alias("text"))


def _linked(rows: DataFrame, size: int, numerator: int, denominator: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``rows(nameless, doc_id, tx, text)`` that have words, and what is known of each node.

    Returns ``(nameless, doc_id, tx, id)`` per row and ``(id, links, first)`` per node. Rows of equal sets are one node,
    whatever their ids; its ``id`` is a hash of the set's signature. ``first`` is the smallest row reachable by links.
    """
    similarity = numerator / denominator
    made = rows.mapInArrow(_features(runs_for(similarity, recall), size), FEATURES)
    features = materialise(made.withColumn("id", F.xxhash64("sig")).drop("sig"), "shingle-features")
    # Keys and sketch depend on the set alone, so any row of a class may give them.
    sizes = features.groupBy("id").agg(F.min(F.struct(*ROW)).alias("first"), F.count("*").alias("weight"))
    classes = materialise(sizes, "shingle-classes")
    own = features.join(classes.select("id", "first.*"), ["id", *ROW], "left_semi")
    nodes = materialise(own.select("id", "n_shingles", "keys", "children", "sketch").dropDuplicates(["id"]), "shingle-nodes")
    members = _leaves(nodes).join(nodes.select("id", "n_shingles", "sketch"), "id")
    candidates = materialise(components(forests(members, "bucket", "id", _sketch_similar(similarity))), "path-candidates")
    weighed = candidates.join(classes, "id").select("first.*", "id", "component", "weight")

    def sets(batches):
        for batch in text_slices(batches, "text"):
            tokens, bounds = shingle_sets(*byte_parts(batch.column("text")), size)
            parts = [tokens[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "component", "weight")], binary_column(parts)], ["id", "component", "weight", "shingles"])

    texts = rows.join(weighed, ROW).select("id", "component", "weight", "text")
    whole = texts.mapInArrow(sets, "id long, component long, weight long, shingles binary").dropDuplicates(["id"])
    found = materialise(degrees(whole, "component", "id", "weight", _jaccard(numerator, denominator), 512), "path-links")
    linked = components(found.where("u is not null").select("u", "v"))
    groups = materialise(linked.join(classes, "id").groupBy("component").agg(F.min("first").alias("group")), "path-groups")
    counts = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    per_class = materialise(
        classes.join(counts, "id", "left").join(linked.join(groups, "component").select("id", "group"), "id", "left")
        .select("id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("group", "first").alias("first")),
        "path-classes",
    )
    return features.select(*ROW, "id"), per_class


def ngram_join(docs: DataFrame, size: int = 5, numerator: int = 4, denominator: int = 5, recall: float = 0.9999) -> DataFrame:
    """Documents whose sets of ``size``-word shingles have a Jaccard similarity of ``numerator / denominator`` or more.

    Takes ``doc_id, text`` (other columns are ignored) and returns per row ``doc_id, n_links, component_id, kept``: the
    number of linked rows, the smallest id reachable by links, and whether that is the row's own. A text of fewer than
    ``size`` words has one shingle of all of them. A NULL text, one without words, and a NULL ``doc_id`` link with nothing
    and are kept. Equal sets are one node with a weight, so repeated rows and copies count as links of each other, and a
    repeated row is kept as often as its id. Different texts of one id are rows of their own. An empty table gives an
    empty result.
    """
    rows = _keyed(docs)
    placed, per_class = _linked(rows.where("nameless = 0"), size, numerator, denominator, recall)
    per_row = placed.join(per_class, "id").groupBy(*ROW).agg(F.max("links").alias("links"), F.min("first.doc_id").alias("component"))
    every = rows.select(*ROW).join(per_row, ROW, "left").withColumn("doc_id", F.when(F.col("nameless") == 0, F.col("doc_id")))
    return every.select(
        "doc_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, size: int = 5, numerator: int = 4, denominator: int = 5, recall: float = 0.9999) -> DataFrame:
    """``docs`` with one row of each group of linked rows and copies: that of the smallest id, NULL last, then text hash.

    Links are those of ``ngram_join``, with two differences: rows are told apart by id and text, not by id, and rows with a
    NULL id link too. Of rows equal in id and text the one whose other columns come first as JSON stays. Texts without
    words, and NULL ones, link with nothing and all stay.
    """
    names = {c: f"_{k}_row" for k, c in enumerate(ROW)}
    placed, per_class = _linked(_keyed(docs), size, numerator, denominator, recall)
    rows = placed.groupBy(*ROW).agg(F.first("id").alias("id"), F.count("*").alias("n")).join(per_class, "id")
    judged = materialise(
        rows.select(*[F.col(c).alias(n) for c, n in names.items()], (F.struct(*ROW) == F.col("first")).alias("_stays"), (F.col("n") > 1).alias("_repeated")),
        "path-rows",
    )
    key = list(names.values())
    tagged = docs.select(*docs.columns, *[_row_part(c).alias(n) for c, n in names.items()])
    single = tagged.join(judged.where("not _stays or _repeated"), key, "left_anti").select(*docs.columns)
    several = tagged.join(judged.where("_stays and _repeated"), key, "left_semi")
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    first = several.groupBy(*key).agg(F.min_by(F.struct(*docs.columns), others).alias("_row")).select("_row.*")
    return single.union(first)
