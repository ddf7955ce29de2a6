"""Target-distribution importance resampling: weights from an array of bucket gains, ranks from a distributed radix sort.

Word runs are hashed into buckets. How much likelier a bucket is in the target than in the corpus is its gain, and the
gains are one array, so a text's weight is a sum of array places. A seeded Gumbel term turns the highest scores into a
draw without replacement. Ranks come from a least-significant-digit radix sort of the composite key (score falling,
id rising, number of features rising): each pass deals the rows into blocks by their place so far, sorts every block
stably by one digit, and a prefix sum over the counts of all digits and blocks gives every row its next place. A pass is
one shuffle of narrow rows; blocks have a bounded size whatever the keys, so no key is a task of its own.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.batches import text_slices
from gridloom.shared import materialise

#: Bits of a sort digit.
DIGIT = 16
#: Rows of a block, which one task sorts at once.
BLOCK = 1 << 18
#: Bytes of a text whose words are held at once.
TILE = 1 << 20
#: Words a task remembers, of at most ``SHORT`` bytes each.
REMEMBERED, SHORT = 500_000, 32

#: Word bytes for themselves, A-Z lower-cased, all else a space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

SCORED = "doc_id long, n_words long, n_features long, weight long, score long, block long, at long"


def _word_tiles(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a tile at a time; a tile ends where a word does."""
    if len(text) <= TILE:
        yield text.translate(_FOLD).split()
        return
    kept = b""
    for first in range(0, len(text), TILE):
        part = kept + text[first : first + TILE].translate(_FOLD)
        end = part.rfind(b" ") + 1
        yield part[:end].split()
        kept = part[end:]
    yield kept.split()


class Buckets(dict):
    """Bucket of a feature; short ones are remembered."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[feature] = bucket
        return bucket

    def of(self, text: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of the features that end there) of each tile of a text."""
        before: list[bytes] = []
        for words in _word_tiles(text):
            found = list(map(self.__getitem__, words))
            line = before + words
            for n in range(2, longest + 1):
                own = line[max(0, len(before) - n + 1) :]
                found += [self[b" ".join(run)] for run in zip(*(own[k:] for k in range(n)))]
            yield len(words), np.array(found, np.int64)
            before = line[-longest + 1 :] if longest > 1 else []


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def _counted(longest: int, buckets: int):
    def work(batches):
        index, counts = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in text_slices(batches, "text"):
            for text in _texts(batch):
                for _, found in index.of(text or b"", longest):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    return work


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of ``texts(text)`` per bucket, repeats counted; tasks add up before anything is shuffled."""
    narrow = texts.select(F.col("text").cast("string").alias("text"))
    rows = narrow.mapInArrow(_counted(longest, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` of each of the B buckets."""
    b, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    """Thousandfold Gumbel term of an id, floored; a NULL id hashes as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(gain: np.ndarray, longest: int, seed: int, block: int):
    def work(batches):
        index = Buckets(len(gain))
        first_block, row = TaskContext.get().partitionId() << 32, 0
        for batch in text_slices(batches, "text"):
            ids, out = batch.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, _texts(batch)):
                n_words = n = total = 0
                for words, found in index.of(text or b"", longest):
                    n_words, n, total = n_words + words, n + len(found), total + int(gain[found].sum())
                weight = total // n if n else 0
                out.append((n_words, n, weight, weight + gumbel(seed, doc), first_block + row // block, row % block))
                row += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight", "score", "block", "at"])

    return work


def _digits(value: Column, low: int, high: int) -> list[Column]:
    """Digits of ``value``, which lies between ``low`` and ``high``, the least first; none if both are equal."""
    if high - low < 1 << 63:
        value, bits = value - F.lit(low).cast("long"), (high - low).bit_length()
    else:
        # The distance would not fit; with the sign bit turned over, bits order as unsigned ones.
        value, bits = value.bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 64
    return [F.shiftrightunsigned(value, k).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long")).cast("int") for k in range(0, bits, DIGIT)]


def _placed(columns: list[str]):
    """Stable counting sort of one block by its digits; ``offsets`` give the first place of each digit's rows."""

    def place(rows: pa.Table, offsets: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(np.asarray(rows["at"]), kind="stable")))
        digit = np.asarray(rows["digit"]).astype(np.uint16 if DIGIT <= 16 else np.int64)
        order = np.argsort(digit, kind="stable")
        counts = np.bincount(digit, minlength=1 << DIGIT)
        first = np.zeros(1 << DIGIT, np.int64)
        first[np.asarray(offsets["digit"])] = np.asarray(offsets["first"])
        digit = digit[order].astype(np.int64)
        within = np.arange(len(order)) - (np.cumsum(counts) - counts)[digit]
        return rows.take(pa.array(order)).select(columns).append_column("at", pa.array(first[digit] + within))

    return place


def radix_pass(rows: DataFrame, digit: Column, block: int) -> DataFrame:
    """``rows(block, at, ...)`` with ``block, at`` after one stable counting sort of all rows by ``digit``.

    ``at`` orders the rows of a block; afterwards it is the row's place among all, from 0.
    """
    columns = [c for c in rows.columns if c not in ("block", "at")]
    told = rows.withColumn("digit", digit)
    counts = told.groupBy("block", "digit").agg(F.count("*").alias("n"))
    counts = materialise(counts, "digit-counts")
    # At most 2 ** DIGIT rows in one order, and one row per block in each other one.
    smaller = Window.partitionBy(F.lit(0)).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(bases, "digit")
    offsets = offsets.select("block", "digit", (F.col("base") + F.col("before")).alias("first"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    moved = told.groupBy("block").cogroup(offsets.groupBy("block")).applyInArrow(_placed(columns), f"{schema}, at long")
    return moved.withColumn("block", F.expr(f"at div {block}"))


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, block: int = BLOCK
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs(doc_id, text)`` against ``target(text)``.

    Words are runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z; features are all runs of 1 to
    ``longest`` words. Of the rows with ``least_words`` words, the ``percent`` in a hundred of the highest scores have a
    rank; the others have none. Ties go to the smaller id, NULL last, then to fewer features; rows alike in all three
    are alike in every column but the rank. A NULL or empty text has no features and a weight of 0; a NULL id hashes
    as an empty one; repeated rows take part as often as they come; other columns are ignored; an empty table gives
    an empty result, and an empty target makes all buckets equally likely there.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = materialise(narrow.mapInArrow(_scores(gain, longest, seed, block), SCORED), "importance-scores")
    able = scored.where(F.col("n_words") >= least_words)
    spans = [F.min("score").alias("s0"), F.max("score").alias("s1"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("n_features").alias("f0"), F.max("n_features").alias("f1")]
    know = able.agg(F.count("*").alias("n"), F.count("doc_id").alias("named"), *spans).first()
    columns = ["doc_id", "n_features", "weight", "score"]
    rows = able.select(*columns, "block", "at")
    if know["n"]:
        digits = _digits(F.col("n_features"), know["f0"], know["f1"])
        if know["named"]:
            digits += _digits(F.coalesce("doc_id", F.lit(know["d0"]).cast("long")), know["d0"], know["d1"])
        if 0 < know["named"] < know["n"]:
            digits.append(F.col("doc_id").isNull().cast("int"))
        digits += _digits(-F.col("score"), -know["s1"], -know["s0"])
        # Without any pass the rows are all alike; one pass by a constant still numbers them.
        for digit in digits or [F.lit(0)]:
            rows = materialise(radix_pass(rows, digit, block), "radix-pass")
    drawn = know["n"] * percent // 100
    ranked = rows.select(*columns, F.when(F.col("at") < drawn, F.col("at") + 1).alias("rank"))
    others = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others)
