"""Quality rules: text statistics, and a decision list learned from labelled statistics by sequential covering.

Rules are grown one threshold at a time for the labelled bad texts, pruned on rows kept apart, and kept while they stay
precise there; what a rule covers is taken out before the next one is grown. The list becomes one ordered conditional
expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import byte_parts, longs, text_slices
from gridloom.llm.words import SEPARATOR, U64, mix, span_hashes, window_hashes, word_spans

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_bars", "n_digits"]

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?")] = True
BAR = np.zeros(256, bool)
BAR[ord("|")] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True


def _between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if len(bounds) == 2:
        return np.array([np.count_nonzero(flags)], np.int64)
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeated_words(words: np.ndarray, word_bounds: np.ndarray, size: int = 5) -> np.ndarray:
    """Words of each text inside a ``size``-word window that the text holds twice or more."""
    texts = len(word_bounds) - 1
    text_of = np.repeat(np.arange(texts), np.diff(word_bounds))
    hashes = window_hashes(words, size)
    inside = np.flatnonzero(text_of[: len(hashes)] == text_of[size - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    keyed = hashes[inside] + mix(text_of[inside].astype(np.uint64) + U64(1))
    order = np.argsort(keyed)
    ordered = keyed[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    at = inside[twice]
    steps[at] += 1
    steps[at + size] -= 1
    return _between(np.cumsum(steps[:-1]) > 0, word_bounds)


def _repeated_lines(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and those with a word that equal an earlier line of it."""
    texts = len(bounds) - 1
    breaks = np.flatnonzero(data == 0x0A)
    text_of_break = np.searchsorted(bounds, breaks, side="right") - 1
    begin = np.concatenate([bounds[:-1], breaks + 1])
    text_of = np.concatenate([np.arange(texts), text_of_break])
    order = np.lexsort((begin, text_of))
    begin, text_of = begin[order], text_of[order]
    last = np.concatenate([text_of[1:] != text_of[:-1], [True]])[: len(begin)]
    end = np.where(last, bounds[text_of + 1], np.concatenate([begin[1:] - 1, [0]])[: len(begin)])
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, owner = begin[worded], end[worded], text_of[worded]
    keyed = span_hashes(data, begin, end) + mix(owner.astype(np.uint64) + U64(1))
    distinct = np.bincount(owner[np.unique(keyed, return_index=True)[1]], minlength=texts)
    return np.bincount(text_of, minlength=texts), np.bincount(owner, minlength=texts) - distinct


def _counts(carried: list[str]):
    """Task function: counts of every text beside the ``carried`` columns."""

    def work(batches):
        for batch in text_slices(batches, "text"):
            data, bounds = byte_parts(batch.column("text"))
            starts, ends, word_bounds = word_spans(data, bounds)
            lines, dup_lines = _repeated_lines(data, bounds, starts)
            repeated = _repeated_words(span_hashes(data, starts, ends), word_bounds)
            del starts, ends
            letters = ~SEPARATOR[data] & ((data & 0xC0) != 0x80)
            columns = [
                np.diff(word_bounds), _between(letters, bounds), _between(SYMBOL[data], bounds), dup_lines,
                repeated, lines, *[_between(kind[data], bounds) for kind in (UPPER, MARK, BAR, DIGIT)],
            ]
            kept = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c.astype(np.int64)) for c in columns]], [*carried, *COUNTS])

    return work


_COUNT_TYPES = ", ".join(f"{c} long" for c in COUNTS)


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of ``COUNTS`` (long) of every whole text; a NULL text counts as empty."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_counts(["doc_id"]), f"doc_id long, {_COUNT_TYPES}")


def statistics() -> dict[str, Column]:
    """The statistics that rules test, as expressions over the counts; ratios of an empty text are 0."""

    def per(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines_per_line": per("n_dup_lines", "n_lines"),
        "repeats_per_word": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "upper_per_char": per("n_upper", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "bars_per_word": per("n_bars", "n_words"),
        "digits_per_char": per("n_digits", "word_chars"),
    }


def base_failed() -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject what holds all of ``tests``: (statistic, at least?, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(columns.values()))), bool)
        for name, least, cut in self.tests:
            hit &= columns[name] >= cut if least else columns[name] <= cut
        return hit

    def condition(self, columns: dict[str, Column]) -> Column:
        hit = F.lit(True)
        for name, least, cut in self.tests:
            hit = hit & (columns[name] >= F.lit(cut) if least else columns[name] <= F.lit(cut))
        return hit


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray, left: np.ndarray, cuts: int, longest: int) -> Rule:
    """Add the test of the highest gain until only bad rows are covered."""
    tests: list[tuple[str, bool, float]] = []
    covered = left.copy()
    while len(tests) < longest and (covered & ~bad).any():
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        best, best_gain = None, 1e-9
        for name, values in columns.items():
            for cut in np.unique(np.quantile(values[covered & bad], np.linspace(0, 1, cuts))) if p else ():
                for least in (True, False):
                    hit = covered & (values >= cut if least else values <= cut)
                    q = int((hit & bad).sum())
                    if q:
                        gain = q * (math.log2(q / int(hit.sum())) - math.log2(p / (p + n)))
                        if gain > best_gain:
                            best, best_gain = (name, least, float(cut)), gain
        if best is None:
            break
        tests.append(best)
        name, least, cut = best
        covered &= columns[name] >= cut if least else columns[name] <= cut
    return Rule(tuple(tests))


def _prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The leading tests that do best on the rows kept apart; the longer rule on a tie."""

    def worth(r: Rule) -> float:
        hit = r.covers(columns)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((Rule(rule.tests[:k]) for k in range(len(rule.tests), 0, -1)), key=worth, default=rule)


def learn_rules(
    columns: dict[str, np.ndarray], bad: np.ndarray, apart: np.ndarray, precision: float = 0.97, cuts: int = 24, longest: int = 4, most: int = 24
) -> list[Rule]:
    """Ordered rules for the ``bad`` rows; rows marked ``apart`` only prune and judge. Empty if there is nothing to learn."""
    grow = {k: v[~apart] for k, v in columns.items()}
    judge = {k: v[apart] for k, v in columns.items()}
    grow_bad, judge_bad = bad[~apart], bad[apart]
    left, judge_left = np.ones(len(grow_bad), bool), np.ones(len(judge_bad), bool)
    rules: list[Rule] = []
    while len(rules) < most and (left & grow_bad).any():
        grown = _grow(grow, grow_bad, left, cuts, longest)
        if not grown.tests:
            break
        rule = _prune(grown, {k: v[judge_left] for k, v in judge.items()}, judge_bad[judge_left])
        hit, judged = rule.covers(grow) & left, rule.covers(judge) & judge_left
        rows = int(hit.sum()) + int(judged.sum())
        right = int((hit & grow_bad).sum()) + int((judged & judge_bad).sum())
        judged_right = int((judged & judge_bad).sum())
        if rows == 0 or right < precision * rows or judged_right < precision * int(judged.sum()):
            break
        rules.append(rule)
        left &= ~hit
        judge_left &= ~judged
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for what no rule rejects: one conditional expression, rules in order."""
    columns = statistics()
    chain = None
    for rule in rules:
        chain = F.when(rule.condition(columns), F.lit(False)) if chain is None else chain.when(rule.condition(columns), F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, label: str = "quality") -> list[Rule]:
    """Rules from at most ``sample_rows`` labelled texts (label 0: bad), the same ones in every run.

    The bound concerns the fitted rows only; statistics of the sample are collected, never texts. Rows with a NULL id or
    label teach nothing. Texts that the base rules reject teach nothing either, since the list never sees them.
    """
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("_label"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample.select("doc_id"), "doc_id", "left_semi")
    counted = text_counts(texts).where(~base_failed()).dropDuplicates(["doc_id"]).join(sample, "doc_id")
    columns = statistics()
    rows = counted.select("doc_id", "_label", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("_fold"), *[e.alias(n) for n, e in columns.items()]).toPandas()
    rows = rows.sort_values("doc_id")
    if rows.empty:
        return []
    return learn_rules({n: rows[n].to_numpy(float) for n in columns}, (rows["_label"] == 0).to_numpy(), (rows["_fold"] == 0).to_numpy())


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every row, repeated rows included.

    A NULL or empty text has no words and fails the base rules. Other columns of ``docs`` are ignored.
    """
    counted = text_counts(docs).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_rows(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns, whatever these are called."""
    others = [c for c in docs.columns if c != "text"]
    narrow = docs.select(F.struct(*[F.col(c) for c in others]).alias("_rest"), "text")
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    counted = narrow.mapInArrow(_counts(["_rest", "text"]), f"_rest {kinds['_rest']}, text {kinds['text']}, {_COUNT_TYPES}")
    kept = counted.where(~base_failed() & verdict(rules))
    return kept.select(*[F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns])
