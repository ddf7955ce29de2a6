"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, so words are labelled first: features of words (the word, its first 3, 4 and 5 letters) that toxic
documents hold far more often than others are cues, and a word with a sure cue is toxic where its document is. A
two-state chain is trained on such words and their neighbourhood. Forward-backward marginals of a whole text give its
toxic spans, and the highest and the summed marginal its score, calibrated on the labelled documents.

Words without a cue share one emission, so runs of them are one power of the transition matrix: a text costs one pass
over its words and a few steps per word with a cue.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import text_slices
from gridloom.shared import materialise

_WORD = re.compile(r"[^\W\d_]+")
#: Words a worker remembers, of at most ``SHORT`` characters each; it starts anew beyond that.
REMEMBERED, SHORT = 600_000, 32
#: Toxic documents that must hold a feature, for a cue.
SUPPORT = 8
#: Words on each side of a labelled one in training.
CONTEXT = 12


def features(word: str) -> tuple[str, ...]:
    low = word.lower()
    return (f"={low}", *[low[:k] for k in (3, 4, 5) if len(low) >= k])


@dataclass(frozen=True)
class Chain:
    """Log potentials: weights of cue features for the toxic state, its bias, transitions, and the calibration."""

    weights: dict[str, float]
    sure: frozenset[str]
    bias: float
    moves: tuple[tuple[float, float], tuple[float, float]]
    scale: tuple[float, float, float] = (-3.0, 1.0, 0.5)

    def emission(self, word: str) -> float | None:
        """Log potential of the toxic state, None for a word without a cue."""
        hit = [self.weights[f] for f in features(word) if f in self.weights]
        return self.bias + sum(hit) if hit else None

    def score(self, highest: float, total: float) -> float:
        a, b, c = self.scale
        z = a + b * _logit(highest) + c * math.log1p(total)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


class Tagger(dict):
    """Marginals of whole texts under a chain; the dictionary holds the emissions of words seen."""

    def __init__(self, chain: Chain) -> None:
        super().__init__()
        self.chain = chain
        self.move = np.exp(np.array(chain.moves))
        self.plain = self.move * np.array([1.0, math.exp(chain.bias)])
        self.powers: dict[int, np.ndarray] = {}

    def __missing__(self, word: str) -> float | None:
        found = self.chain.emission(word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def _over(self, n: int) -> np.ndarray:
        """Transition over ``n`` words without a cue, scaled; beyond 4096 of them it no longer changes."""
        n = min(n, 4096)
        if n not in self.powers:
            matrix, base, k = np.eye(2), self.plain / self.plain.max(), n
            while k:
                if k & 1:
                    matrix = matrix @ base
                    matrix /= matrix.max()
                base = base @ base
                base /= base.max()
                k >>= 1
            self.powers[n] = matrix
        return self.powers[n]

    def marginals(self, text: str) -> list[tuple[int, float]]:
        """(word number, probability of the toxic state) of each word with a cue."""
        words = _WORD.findall(text)
        emissions = list(map(self.__getitem__, words))
        at = [k for k, e in enumerate(emissions) if e is not None]
        if not at:
            return []
        forward: list[np.ndarray] = []
        for n, k in enumerate(at):
            own = np.array([1.0, math.exp(min(emissions[k], 50.0))])
            if n:
                state = forward[-1] @ self._over(k - at[n - 1] - 1) @ self.move * own
            elif k:
                state = np.array([1.0, math.exp(self.chain.bias)]) @ self._over(k - 1) @ self.move * own
            else:
                state = own
            forward.append(state / state.sum())
        out: list[tuple[int, float]] = []
        back = self._over(len(words) - 1 - at[-1]) @ np.ones(2)
        for n in range(len(at) - 1, -1, -1):
            k = at[n]
            both = forward[n] * back
            out.append((k, float(both[1] / both.sum())))
            if n:
                own = np.array([1.0, math.exp(min(emissions[k], 50.0))])
                back = self._over(k - at[n - 1] - 1) @ (self.move @ (own * back))
                back = back / back.sum()
        return out[::-1]

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int]]:
        """Character spans of the words more likely toxic than not; neighbours are joined."""
        toxic = {k for k, p in self.marginals(text) if p >= least}
        out: list[tuple[int, int]] = []
        before = -2
        for k, word in enumerate(_WORD.finditer(text)) if toxic else ():
            if k in toxic:
                if before == k - 1:
                    out[-1] = (out[-1][0], word.end())
                else:
                    out.append((word.start(), word.end()))
                before = k
        return out


def _cue_counts(batches):
    """Documents of each class that hold a feature, summed over a task's batches as far as memory is small."""
    toxic, clean = Counter(), Counter()

    def out():
        names = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())],
            ["feature", "toxic", "clean"],
        )

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = set(_WORD.findall(text or ""))
            (toxic if label else clean).update({f for w in words for f in features(w)})
        if len(toxic) + len(clean) > 500_000:
            yield out()
            toxic.clear()
            clean.clear()
    if toxic or clean:
        yield out()


def _windows(cues: frozenset[str], sure: frozenset[str], per_text: int):
    """Task function: a window of words around one occurrence of each different cue word of a text, and one elsewhere.

    Which occurrence it is follows from hashes, so windows lie anywhere in a text. ``picked`` marks ``per_text`` of a text's
    windows; ``cues`` are those of the word in the middle.
    """

    def work(batches):
        for batch in batches:
            rows = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = _WORD.findall(text or "")
                if not words:
                    continue
                held = {w: [f for f in features(w) if f in cues] for w in set(words)}
                seed = zlib.crc32(text.encode())
                best: dict[str, tuple[int, int]] = {}
                for k, w in enumerate(words):
                    if held[w]:
                        low = w.lower()
                        best[low] = min(best.get(low, (1 << 32, 0)), (zlib.crc32(f"{seed}:{k}".encode()), k))
                # Words with a sure cue come first, in toxic texts and others alike.
                line = sorted((not any(f in sure for f in held[words[k]]), h, k) for h, k in best.values())
                line = [(h, k, True) for _, h, k in line]
                for n, (h, k, of_cue) in enumerate([*line, (0, len(words) // 2, False)]):
                    part = words[max(0, k - CONTEXT) : k + CONTEXT + 1]
                    labels = [int(bool(label) and any(f in sure for f in features(w))) for w in part]
                    rows.append((part, labels, h, held[words[k]] if of_cue else [], n < per_text or not of_cue))
            if rows:
                kinds = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.string()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["words", "labels", "h", "cues", "picked"])

    return work


def training_windows(texts: DataFrame, cues: frozenset[str], sure: frozenset[str], per_text: int = 4) -> list[tuple[list[str], list[int]]]:
    """Windows the chain is trained on: ``per_text`` around cues and one elsewhere of each text, and one of every cue."""
    found = texts.mapInArrow(_windows(cues, sure, per_text), "words array<string>, labels array<int>, h long, cues array<string>, picked boolean")
    found = materialise(found, "toxic-windows")
    window = F.struct("words", "labels").alias("window")
    each = found.select(F.explode("cues").alias("cue"), "h", window).groupBy("cue").agg(F.min_by("window", F.struct("h", "window")).alias("window"))
    chosen = found.where("picked").select(window).unionByName(each.select("window"))
    return sorted((r["words"], r["labels"]) for r in chosen.select("window.*").collect())


def train_chain(windows: list[tuple[list[str], list[int]]], cues: list[str], sure: frozenset[str], steps: int = 120, ridge: float = 1e-3) -> Chain:
    """Maximum conditional likelihood of the labelled windows, by Adam on the whole of them."""
    number = {c: k for k, c in enumerate(cues)}
    n, wide, none = len(windows), 2 * CONTEXT + 1, len(cues)
    held = np.full((n, wide, 4), none, np.int64)
    truth, mask = np.zeros((n, wide), np.int64), np.zeros((n, wide), bool)
    for i, (words, labels) in enumerate(windows):
        mask[i, : len(words)] = True
        truth[i, : len(labels)] = labels
        for j, word in enumerate(words):
            for k, f in enumerate(features(word)):
                held[i, j, k] = number.get(f, none)
    theta = np.zeros(none + 5)  # weights, bias, then the four moves
    theta[none] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    onehot = np.stack([truth == 0, truth == 1], axis=2) & mask[:, :, None]
    pairs = (onehot[:, :-1, :, None] & onehot[:, 1:, None, :]).sum(axis=(0, 1))
    for step in range(1, steps + 1):
        weights = np.append(theta[:none], 0.0)
        toxic = np.exp(np.clip(theta[none] + weights[held].sum(axis=2), -30, 30))
        psi = np.stack([np.ones_like(toxic), toxic], axis=2)
        move = np.exp(theta[none + 1 :].reshape(2, 2))
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, wide):
            grown = (alpha[:, t - 1] @ move) * psi[:, t]
            alpha[:, t] = np.where(mask[:, t, None], grown / grown.sum(axis=1, keepdims=True), alpha[:, t - 1])
        for t in range(wide - 2, -1, -1):
            grown = (psi[:, t + 1] * beta[:, t + 1]) @ move.T
            beta[:, t] = np.where(mask[:, t + 1, None], grown / grown.sum(axis=1, keepdims=True), beta[:, t + 1])
        both = alpha * beta
        both = both / both.sum(axis=2, keepdims=True) * mask[:, :, None]
        edge = alpha[:, :-1, :, None] * move * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
        edge = edge / edge.sum(axis=(2, 3), keepdims=True) * mask[:, 1:, None, None]
        gap = (onehot[:, :, 1] - both[:, :, 1]) / n
        slope = np.zeros_like(theta)
        slope[:none] = np.bincount(held.ravel(), np.repeat(gap.ravel(), 4), none + 1)[:none] - ridge * theta[:none]
        slope[none] = gap.sum()
        slope[none + 1 :] = ((pairs - edge.sum(axis=(0, 1))) / n).ravel() - ridge * theta[none + 1 :]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    moves = theta[none + 1 :].reshape(2, 2)
    return Chain(dict(zip(cues, theta[:none].tolist())), sure, float(theta[none]), tuple(map(tuple, moves.tolist())))


def _calibrated(points: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on (logit of the highest marginal, log of one plus the sum), by Newton steps."""
    design = np.column_stack([np.ones(len(points)), points])
    theta = np.array([-3.0, 1.0, 0.5])
    penalty = np.array([1e-3, 1e-2, 1e-2]) * len(points) / 100

    def loss(at: np.ndarray) -> float:
        z = design @ at
        return float(np.logaddexp(0, np.where(labels > 0, -z, z)).sum() + (penalty * at**2).sum() / 2)

    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (labels - p) - penalty * theta
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step, now = np.linalg.solve(curve, slope), loss(theta)
        while loss(theta + step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        theta = theta + step
    return tuple(theta.tolist())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: CRC-32 of the id as text divisible by 5; a NULL id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _summary(tagger: Tagger, text: str) -> tuple[float, float]:
    marginals = [p for _, p in tagger.marginals(text)]
    return (max(marginals), sum(marginals)) if marginals else (0.0, 0.0)


def fit_chain(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, label: str = "toxic", per_text: int = 4) -> Chain | None:
    """Chain learned from at most ``sample_rows`` labelled documents that are not held out; None if they show one class.

    The bound concerns the fitted rows only, and they are the same in every run: the lowest hashes of ids. Whole texts are
    read in tasks; what reaches the driver are feature counts over a threshold, and of the windows around cues in whole texts
    ``per_text`` of each text, one more elsewhere in it, and one of each cue.
    """
    known = labels.where(f"doc_id is not null and {label} is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(sample_rows)
    picked = materialise(picked, "toxic-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    texts = materialise(texts.select("text", "label"), "toxic-texts")
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n_toxic, n_clean = sum(n for k, n in sizes.items() if k), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return None
    support = min(SUPPORT, max(2, n_toxic // 8))
    counted = texts.mapInArrow(_cue_counts, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    lift = F.log(((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("c") + 0.5) / (n_clean + 1))).alias("lift")
    found = sorted(tuple(r) for r in counted.where(F.col("t") >= support).select("feature", "t", "c", lift).where("lift >= 1.5").collect())
    sure = frozenset(f for f, t, c, up in found if c * n_toxic <= 0.02 * t * n_clean)
    cues = [f for f, *_ in found]
    if not sure:
        return None
    chain = train_chain(training_windows(texts, frozenset(cues), sure, per_text), cues, sure)

    def summaries(batches):
        tagger = Tagger(chain)
        for batch in batches:
            pairs = [_summary(tagger, t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), batch.column("label")], ["highest", "total", "label"])

    rows = np.array(sorted(tuple(r) for r in texts.mapInArrow(summaries, "highest double, total double, label int").collect()), float)
    points = np.column_stack([[_logit(p) for p in rows[:, 0]], np.log1p(rows[:, 1])])
    return Chain(chain.weights, chain.sure, chain.bias, chain.moves, _calibrated(points, rows[:, 2]))


def scored(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """``doc_id, held_out, score, predicted, highest, spans`` of every whole text of ``docs(doc_id, text)``.

    ``spans`` are the character spans of words more likely toxic than not, of the likeliest one where a toxic text has
    none. A NULL or empty text has no marginals and takes the lowest score, as has every text without a chain (a score of
    0). Repeated rows are scored as often as they come; other columns are ignored; an empty table gives an empty result.
    """

    def work(batches):
        tagger = Tagger(chain) if chain else None
        for batch in text_slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pairs = [_summary(tagger, t) if chain else (0.0, 0.0) for t in texts]
            scores = [chain.score(*p) if chain else 0.0 for p in pairs]
            spans = [[{"first": a, "end": b} for a, b in tagger.spans(t, min(0.5, p[0]))] if p[0] >= 0.5 or s >= 0.5 and p[0] else [] for t, p, s in zip(texts, pairs, scores)]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([p[0] for p in pairs], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "highest", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = narrow.mapInArrow(work, "doc_id long, score double, highest double, spans array<struct<first: int, end: int>>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "highest", "spans")
