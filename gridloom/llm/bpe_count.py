"""Token counts of a sentence-piece vocabulary by heap-and-linked-list byte-pair merging, without identifiers.

The symbols of a word form a linked list, its adjacent pairs that are pieces of the vocabulary a heap. The best pair is
merged and its new neighbours join the heap, until no pair is left: the count is the initial symbols minus the merges.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import text_slices

#: The mark that stands for a space in the vocabulary.
SPACE = "▁"
#: Word counts a worker remembers, of words of at most ``SHORT`` characters (some 200 bytes each); it starts anew beyond that.
REMEMBERED, SHORT = 1_400_000, 40
#: Characters of a text that is split at once.
TILE = 1 << 18

_RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_EDGE = re.compile(f"[^ {SPACE}](?=[ {SPACE}])")


class Counter(dict):
    """Number of tokens of texts; the dictionary holds the counts of words seen, each with the space before it."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.library
        whole = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        #: Lower ranks merge first.
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in whole}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.rank):
            raise ValueError("the vocabulary merges over spaces")
        self.bytes = any(model.is_byte(i) for i in range(model.vocab_size()))

    def merged(self, text: str) -> int:
        """Tokens of ``text``: characters of the vocabulary, and the bytes of others, minus merges."""
        rank = self.rank
        symbols: list[str | None] = list(text)
        n = len(symbols)
        count = n
        for s in symbols:
            if s not in rank and self.bytes:
                count += len(s.encode()) - 1
        heap = []
        for at in range(n - 1):
            pair = symbols[at] + symbols[at + 1]
            if pair in rank:
                heap.append((rank[pair], at, pair))
        if not heap:
            return count
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, left, pair = heappop(heap)
            first, right = symbols[left], after[left]
            # The pair is gone if one of its symbols has been merged since.
            if first is None or right >= n or len(first) + len(symbols[right]) != len(pair) or first + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, None
            count -= 1
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
                wider = pair + symbols[beyond]
                if wider in rank:
                    heappush(heap, (rank[wider], left, wider))
            back = before[left]
            if back >= 0:
                wider = symbols[back] + pair
                if wider in rank:
                    heappush(heap, (rank[wider], back, wider))
        return count

    def __missing__(self, word: str) -> int:
        count = self.merged(SPACE + word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text; one space goes before it, as the library adds it."""
        if not text:
            return 0
        count, first = 0, 0
        while first < len(text):
            # A tile ends where a run of spaces begins, so merges, which never cross into one, stay inside.
            end = _EDGE.search(text, first + TILE) if len(text) > first + 2 * TILE else None
            last = end.start() + 1 if end else len(text)
            marked = ("" if first else SPACE) + text[first:last].replace(" ", SPACE)
            if marked[0] == SPACE and SPACE + SPACE not in marked:
                count += sum(map(self.__getitem__, marked[1:].split(SPACE)))
            else:
                count += sum(map(self.merged, _RUN.findall(marked)))
            first = last
        return count


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs(doc_id, text)``, repeated rows included.

    A NULL text counts as empty, and an empty one has no tokens; other columns are ignored. ``vocabulary`` is a file
    that every executor can open, such as one of an installed package.
    """

    def work(batches):
        count = counter(vocabulary).count
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(np.array([count(t or "") for t in texts], np.int64))],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = narrow.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
