"""Removal of long repeated strings by column-wise suffix ordering of many documents.

A byte goes if a string of ``length`` bytes covering it also starts anywhere else. Every window of that length names an
anchor, the smallest hash among its inner ``GRAM``-byte strings, which depends on the window's bytes alone: equal windows
agree on it. So only texts around equal anchors have to be compared, and they are aligned at the anchor. Each collection
of such texts is built up column by column from the right: a round inserts one symbol per text, which orders the texts by
their suffixes from that column on (a stable sort by the new symbol of the order so far; the sorted symbols are the
column of the collection's Burrows-Wheeler transform) and updates the common prefixes of neighbours (one more than the
least common prefix between them where they share the symbol, else none). Neighbours with ``length`` bytes in common
hold equal windows. The columns are read and written in sequence, a round needs the last one only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import byte_parts, key_runs, longs, text_slices
from gridloom.llm.words import BYTE_VALUE, SpanHash, U64, mix
from gridloom.shared import materialise

#: Bytes of an anchor.
GRAM = 64
#: Distinct texts around one anchor that one task orders; anchors with more are cut finer.
CROWD = 1 << 14
#: Window starts per finer cut; with one start each, texts of a cut are equal and need no ordering.
FINER = (48, 6, 1)
#: Bytes ordered together.
LOT = 3 << 20

ANCHORS = "doc_id long, tx long, s long, n long, o long, h long, k long"


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``values[i : i + width]`` for every full window."""
    have, step = values, 1
    while 2 * step <= width:
        have, step = np.minimum(have[: len(have) - step], have[step:]), 2 * step
    return np.minimum(have[: len(values) - width + 1], have[width - step : len(values) - step + 1])


def _runs(data: np.ndarray, bounds: np.ndarray, length: int):
    """Runs of windows with one anchor: (text, start, windows, anchor offset, anchor hash, run hash) as arrays."""
    if len(data) < length:
        return None
    spans = SpanHash(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = spans(at, at + GRAM)
    # Hash above, place below: the least is the first of the smallest hashes. Slices stay far below 2 ** 24 bytes.
    placed = (mix(grams + U64(7)) & ~U64((1 << 24) - 1)) | at.astype(np.uint64)
    anchor = (_least_in_window(placed, length - GRAM + 1) & U64((1 << 24) - 1)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(bounds, starts, side="right") - 1
    inside = starts + length <= bounds[text + 1]
    starts, anchor, text = starts[inside], anchor[inside], text[inside]
    if not len(starts):
        return None
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(fresh)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    s, p = starts[first], anchor[first]
    return text[first], s - bounds[text[first]], count, p - s, grams[p], spans(s, s + count + length - 1)


def _tiles(batches, length: int):
    """Slices with the offset of their first byte; a longer text is cut into tiles that overlap by a window."""
    tile = 1 << 20
    for batch in text_slices(batches, "text"):
        data, bounds = byte_parts(batch.column("text"))
        if len(data) <= tile + length:
            yield batch, data, bounds, 0
        else:
            for first in range(0, len(data) - length + 1, tile):
                part = data[first : first + tile + length - 1]
                yield batch, part, np.array([0, len(part)], np.int64), first


def _anchors(length: int):
    def work(batches):
        for batch, data, bounds, first in _tiles(batches, length):
            found = _runs(data, bounds, length)
            if found is None:
                continue
            text, s, n, o, h, k = found
            rows = batch.select(["doc_id", "tx"]).take(pa.array(text))
            columns = [pa.array(x.astype(np.int64)) for x in (s + first, n, o)] + [pa.array(x.view(np.int64)) for x in (h, k)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], ["doc_id", "tx", "s", "n", "o", "h", "k"])

    return work


def _finer(length: int, width: int):
    """Cut runs of window starts, aligned at their anchor, by the bytes all windows of a cut share."""

    def work(batches):
        for batch in text_slices(batches, "text"):
            for row in range(batch.num_rows):
                data, _ = byte_parts(batch.column("text").slice(row, 1))
                for run in batch.column("runs")[row].as_py():
                    # Places from here on are those in the run's own bytes, which are two windows at most.
                    spans = SpanHash(data[run["s"] : run["s"] + run["n"] + length - 1])
                    at, run["s"] = run["s"], 0
                    p, low = run["o"], run["o"] - run["n"] + 1
                    cut = np.arange(low // width, run["o"] // width + 1)
                    first = np.maximum(run["s"], p - (cut * width + width - 1))
                    last = np.minimum(run["s"] + run["n"] - 1, p - cut * width)
                    shared = spans(p - cut * width, p - (cut * width + width - 1) + length)
                    h = mix(np.array([run["h"]], np.int64).view(np.uint64) ^ mix(cut.astype(np.uint64) + U64(width << 16))) ^ shared
                    k = spans(first, last + length)
                    times = len(cut)
                    columns = [pa.array(x.astype(np.int64)) for x in (first + at, last - first + 1, p - first)] + [pa.array(mix(h).view(np.int64)), pa.array(k.view(np.int64))]
                    same = [batch.column(c).slice(row, 1).take(pa.array(np.zeros(times, np.int64))) for c in ("doc_id", "tx")]
                    yield pa.RecordBatch.from_arrays([*same, *columns], ["doc_id", "tx", "s", "n", "o", "h", "k"])

    return work


def _texts(length: int):
    """The bytes of each listed run."""

    def work(batches):
        for batch in text_slices(batches, "text"):
            data, bounds = byte_parts(batch.column("text"))
            out = []
            for row, runs in enumerate(batch.column("runs").to_pylist()):
                text = data[bounds[row] : bounds[row + 1]].tobytes()
                out += [(r["h"], r["k"], r["n"], r["o"], text[r["s"] : r["s"] + r["n"] + length - 1]) for r in runs]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()])], ["h", "k", "n", "o", "string"])

    return work


def order_columns(group: np.ndarray, offset: np.ndarray, windows: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """For aligned texts, sorted by ``group``: which windows also start in another text of the group.

    ``offset`` is the place of the anchor in each text. Returns a boolean matrix (column from the leftmost, text).
    """
    m = len(texts)
    sizes = np.array([len(t) for t in texts])
    left, right = int(offset.max()), int((sizes - offset).max())
    symbols = np.full((left + right, m), -1, np.int16)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(m), sizes)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols[within - offset[owner] + left, owner] = flat
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    repeated = np.zeros((left + 1, m), bool)
    base = group.astype(np.int32) * 512
    for column in range(left + right - 1, -1, -1):
        symbol = symbols[column][order]
        key = base[order] + symbol
        if (key[1:] < key[:-1]).any():
            turn = np.argsort(key, kind="stable")
            key, symbol = key[turn], symbol[turn]
            x, y = turn[:-1], turn[1:]
            least = common[y].copy()
            apart = np.flatnonzero((y != x + 1) & (key[1:] == key[:-1]))
            if len(apart):
                ranges = np.stack([x[apart] + 1, y[apart] + 1], axis=1).ravel()
                least[apart] = np.minimum.reduceat(common, ranges)[::2]
            order = order[turn]
        else:
            least = common[1:m]
        grown = np.zeros(m + 1, np.int32)
        grown[1:m] = np.where((key[1:] == key[:-1]) & (symbol[1:] >= 0), least + 1, 0)
        common = grown
        if column <= left:
            start = column - left + offset[order]
            hit = (np.maximum(common[:-1], common[1:]) >= length) & (start >= 0) & (start < windows[order])
            repeated[column, order[hit]] = True
    return repeated


def _ordered(length: int):
    """Stream sorted groups, order some of them together, emit runs of repeated windows."""

    def solve(tables):
        whole = pa.concat_tables(tables).combine_chunks()
        h, k, n, o = (longs(whole, c) for c in ("h", "k", "n", "o"))
        group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))
        repeated = order_columns(group, o, n, whole.column("string").to_pylist(), length)
        left = repeated.shape[0] - 1
        edge = np.diff(np.pad(repeated.T, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        text, first = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        shift = o[text] - left
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[text], k[text], first + shift, end - 1 + shift)], ["h", "k", "a", "b"])

    def work(batches):
        held, size = [], 0
        for table in key_runs(batches, ["h"]):
            if table.num_rows > 1:
                held.append(table)
                size += table.num_rows * (2 * length)
            if size >= LOT:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    return work


def _with_runs(rows: DataFrame, runs: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    lists = runs.groupBy("doc_id", "tx").agg(F.collect_list(F.struct(*columns)).alias("runs"))
    lists = lists.select(F.col("doc_id").alias("_d"), F.col("tx").alias("_t"), "runs")
    return rows.join(lists, rows["doc_id"].eqNullSafe(lists["_d"]) & (rows["tx"] == lists["_t"]), how).drop("_d", "_t")


def _cut(carried: list[str]):
    """Task function: what is left of every text beside the ``carried`` columns."""

    def work(batches):
        for batch in text_slices(batches, "text"):
            data, bounds = byte_parts(batch.column("text"))
            out = []
            for row, spans in enumerate(batch.column("runs").to_pylist()):
                text = data[bounds[row] : bounds[row + 1]]
                gone = np.zeros(len(text), bool)
                for span in spans or ():
                    gone[span["first"] : span["end"]] = True
                kept = text[~gone].tobytes()
                starts = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), kept, kept.decode(errors="ignore")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *columns], [*carried, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "kept_text"])

    return work


_LEFT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary, kept_text string"


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, text, tx`` of every row; ``more`` columns come along as ``_rest``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [column.alias("_rest") for column in more]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tx"), *rest)


def repeated_spans(docs: DataFrame, length: int = 400, crowd: int = CROWD) -> DataFrame:
    """``doc_id, tx, first, end``: byte spans covered by a repeated string of ``length`` bytes; spans may overlap.

    ``tx`` is the 64-bit hash of the text, for tables that hold an id more than once.
    """
    rows = _keyed(docs)
    anchors = materialise(rows.mapInArrow(_anchors(length), ANCHORS), "anchors")

    def classes(of: DataFrame) -> DataFrame:
        rep = F.min(F.struct("doc_id", "tx", "s", "n", "o")).alias("rep")
        return of.groupBy("h", "k").agg(F.count("*").alias("m"), rep)

    for width in FINER:
        crowded = materialise(anchors.select("h", "k").distinct().groupBy("h").agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select("h"), "crowds")
        if crowded.isEmpty():
            break
        wide = _with_runs(rows.select("doc_id", "text", "tx"), anchors.join(crowded, "h", "left_semi").distinct(), ["s", "n", "o", "h"])
        finer = wide.select("doc_id", "tx", "text", "runs").mapInArrow(_finer(length, width), ANCHORS)
        anchors = materialise(anchors.join(crowded, "h", "left_anti").unionByName(finer), "anchors")

    grouped = materialise(classes(anchors), "anchor-classes")
    crowds = grouped.groupBy("h").agg(F.sum("m").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    shared = materialise(grouped.join(crowds, "h").select("h", "k", "m", "kinds", "rep.*"), "shared-anchors")
    mixed = shared.where("kinds > 1")
    texts = _with_runs(rows, mixed, ["s", "n", "o", "h", "k"]).dropDuplicates(["doc_id", "tx"])
    strings = texts.select("text", "runs").mapInArrow(_texts(length), "h long, k long, n long, o long, string binary")
    ordered = strings.repartition("h").sortWithinPartitions("h").mapInArrow(_ordered(length), "h long, k long, a long, b long")
    single = shared.where("m = 1").select("h", "k")
    partly = ordered.join(single, ["h", "k"], "left_semi")
    fully = shared.where("m > 1").select("h", "k", F.lit(0).cast("long").alias("a"), (F.col("n") - 1).alias("b"))
    found = materialise(partly.unionByName(fully), "repeated")
    return anchors.join(found, ["h", "k"]).select("doc_id", "tx", (F.col("s") + F.col("a")).alias("first"), (F.col("s") + F.col("b") + length).alias("end"))


def without_repeats(docs: DataFrame, length: int = 400, crowd: int = CROWD) -> DataFrame:
    """``doc_id, tx, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes, kept_text`` of every row of ``docs(doc_id, text)``.

    Texts are UTF-8 bytes, NULL is empty; matches never cross texts, overlaps within one count, and strings are judged on
    the input. Repeated rows are copies of each other, so one of ``length`` bytes or more loses everything. A row with a
    NULL ``doc_id`` is treated like any other; other columns are ignored; an empty table gives an empty result.
    ``kept_bytes`` are the remaining bytes, which may begin or end inside a character;
    ``kept_text`` leaves such parts of characters out.
    """
    rows = _keyed(docs)
    joined = _with_runs(rows, repeated_spans(docs, length, crowd).distinct(), ["first", "end"], "left")
    return joined.select("doc_id", "tx", "text", "runs").mapInArrow(_cut(["doc_id", "tx"]), f"doc_id long, tx long, {_LEFT}")


def cleaned_rows(docs: DataFrame, length: int = 400, crowd: int = CROWD) -> DataFrame:
    """``docs`` with repeats cut out of ``text`` and all other columns as they are, whatever these are called.

    Characters that a cut goes through are dropped; a text that is all repeats becomes empty, and a NULL one too.
    """
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*[F.col(c) for c in others])
    kind = docs.select(rest.alias("_rest")).schema["_rest"].dataType.simpleString()
    joined = _with_runs(_keyed(docs, rest), repeated_spans(docs, length, crowd).distinct(), ["first", "end"], "left")
    left = joined.select("_rest", "text", "runs").mapInArrow(_cut(["_rest"]), f"_rest {kind}, {_LEFT}")
    return left.select(*[F.col("kept_text").alias(c) if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns])
