"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

How far to the right a token can depend on what follows is a property of the merge list. Two inputs that agree up to a
place first differ in a merge across it, which reaches as far to its left as the merge's left part; from there on a
difference moves left only by a later merge whose right part has grown from the token at the difference's edge, and again
by that merge's left part. The longest such chain, found in one pass over the merges by rank, is the lookahead: a token
that ends so many symbols before the end of what has been read is final. The transducer holds a fixed number of symbols
beyond that, whatever the text's length, and emits tokens as they become final. Texts are split into words tile by tile;
a word without end goes through many tiles.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import binary_column, text_slices

#: Characters of a text that are split into words at once.
TILE = 1 << 16
#: Ids in an output row; a longer text takes several rows.
PART = 1 << 16
#: Words a worker remembers, of at most ``SHORT`` characters each (some 300 bytes with their ids).
REMEMBERED, SHORT = 400_000, 32

#: Below this code point characters are their own normal form, and all engines agree on letters, numbers and cases.
PLAIN_END = "\u0300"
#: White space to some engines only.
_DOUBTFUL = regex.compile("[\x1c-\x1f\x85]")
ENCODED = "doc_id long, part long, last boolean, ids binary"


def _byte_letters() -> list[str]:
    """Code points that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], size: dict[str, int]) -> int:
    """Symbols after a token that settle it, whatever follows; ``size`` is each token's number of symbols.

    ``merges`` are in the order of their rank, each of tokens made before it.
    """
    left: dict[str, str] = {}
    #: Longest reach of a chain whose last merge so far has this left part.
    reach: dict[str, int] = {}
    longest = 1
    for u, v in merges:
        far, token = 0, v
        while token is not None:
            far = max(far, reach.get(token, 0))
            token = left.get(token)
        own = size[u] + far
        reach[u] = max(reach.get(u, 0), own)
        left[u + v] = u
        longest = max(longest, own)
    # The last symbol of a word has a form of its own, so what has been read may differ in its last symbol already.
    return longest + 1


class Vocabulary:
    """Merges, words and special tokens of a tokenizers file that splits by a pattern and marks the ends of words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        self.end = model.get("end_of_word_suffix") or ""
        splits = [s for s in (told["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split"]
        kinds = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        if len(splits) != 1 or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the vocabulary splits or normalises in a way that is not supported")
        self.words = regex.compile(splits[0]["pattern"]["Regex"], regex.V0)
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        # A token's symbols are its characters, the mark of a word's end aside.
        size = {t: len(t) - (len(self.end) if self.end and t.endswith(self.end) and t != self.end else 0) for t in self.ids}
        made: set[str] = set()
        for u, v in merges:
            if u + v in made or any(size[t] > 1 and t not in made for t in (u, v)):
                raise ValueError("a merge comes before its parts, or makes a token again")
            made.add(u + v)
        self.lookahead = lookahead(merges, size)
        self.window = self.lookahead + max(size.values())
        self.size = {i: size[t] for t, i in self.ids.items()}
        letters = _byte_letters()
        self.symbols = letters
        self.closing = [c + self.end for c in letters]
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {c: i for c, i in special.items()}
        self.specials = regex.compile("|".join(sorted(map(regex.escape, special), key=len, reverse=True)) or r"(?!)")
        every = {**{i: t for t, i in self.ids.items()}, **{i: c for c, i in special.items()}}
        self.names = [every.get(i, "") for i in range(max(every) + 1)]

    def merged(self, symbols: list[str]) -> list[int]:
        """Ids of the symbols after all merges, lowest rank first and left-most within a rank."""
        rank, n = self.rank, len(symbols)
        if n == 2:
            pair = symbols[0], symbols[1]
            return [self.ids["".join(pair)]] if pair in rank else [self.ids[s] for s in symbols]
        heap = [(rank[pair], at) for at, pair in enumerate(zip(symbols, symbols[1:])) if pair in rank]
        if not heap:
            return [self.ids[s] for s in symbols]
        heapify(heap)
        line: list[str | None] = list(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            order, at = heappop(heap)
            right = after[at]
            # The pair is gone if one of its symbols has been merged since.
            if line[at] is None or right >= n or rank.get((line[at], line[right])) != order:
                continue
            line[at] += line[right]
            line[right] = None
            beyond = after[at] = after[right]
            if beyond < n:
                before[beyond] = at
                found = rank.get((line[at], line[beyond]))
                if found is not None:
                    heappush(heap, (found, at))
            back = before[at]
            if back >= 0:
                found = rank.get((line[back], line[at]))
                if found is not None:
                    heappush(heap, (found, back))
        return [self.ids[s] for s in line if s is not None]


class Transducer:
    """Ids of one word fed in parts: of its symbols only those not yet settled are held."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.held: list[str] = []
        self.latest = b""

    def feed(self, part: str) -> list[int]:
        """Ids that became final by reading ``part``; the word goes on."""
        data, out, wide = self.latest + part.encode(), [], 2 * self.v.window
        # The last byte is held back, since it has another symbol where the word ends.
        for first in range(0, len(data) - 1, wide):
            self.held += [self.v.symbols[b] for b in data[first : min(first + wide, len(data) - 1)]]
            while len(self.held) >= wide:
                done = 0
                for token in self.v.merged(self.held[:wide]):
                    if done + self.v.size[token] > wide - self.v.lookahead:
                        break
                    out.append(token)
                    done += self.v.size[token]
                del self.held[:done]
        self.latest = data[-1:]
        return out

    def close(self) -> list[int]:
        """Ids of all that is left of the word."""
        symbols = self.held + [self.v.closing[b] for b in self.latest]
        self.held, self.latest = [], b""
        return self.v.merged(symbols) if len(symbols) > 1 else [self.v.ids[s] for s in symbols]


def _seconds() -> frozenset[str]:
    """Characters that may join the one before them in a normal form."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    jamo = map(chr, range(0x1100, 0x1200))
    return frozenset([*(chr(int(p[1], 16)) for p in parts if len(p) == 2 and p[0][0] != "<"), *jamo])


@cache
def _kind(c: str, seconds: frozenset[str]) -> str:
    """L, N, or O for a letter, number or other mark to every engine, that normal form and case leave one; else empty."""
    if c in seconds or unicodedata.combining(c) or len(c.lower()) != 1 or unicodedata.normalize("NFC", c) != c:
        return ""
    return {"L": "L", "N": "N", "P": "O", "S": "O"}.get(unicodedata.ucd_3_2_0.category(c)[0], "")


class Encoder(dict):
    """Ids of whole texts; the dictionary holds short words seen, as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.v = Vocabulary(path)
        self.seconds = _seconds()

    def __missing__(self, word: str) -> bytes:
        one = Transducer(self.v)
        found = np.array(one.feed(word) + one.close(), "<u4").tobytes()
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def _cut(self, text: str, first: int) -> tuple[int, bool]:
        """(end, whether a word goes on there) of the tile of ``text`` that begins at ``first``."""
        size = TILE
        while first + size < len(text):
            space = text.rfind(" ", first + size // 2, first + size)
            if space > first:
                return space, False
            for p in range(first + size - 1, first + size // 2, -1):
                kinds = [_kind(c, self.seconds) for c in text[p - 4 : p + 1]]
                if kinds[3] == "N" and kinds[4]:
                    return p, False
                # Four letters before: what ends here is a run of letters, no contraction.
                if kinds == ["L"] * 5 or (kinds[3:] == ["O", "O"] and text[p] != "'"):
                    return p, True
            size *= 2
        return len(text), False

    def _words(self, tile: str) -> list[str]:
        v = self.v
        if tile.isascii() or max(tile) < PLAIN_END:
            if not _DOUBTFUL.search(tile):
                return v.words.findall(tile.lower())
        normal = v.library.normalizer.normalize_str(tile)
        return [normal[a:b] for _, (a, b) in v.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _segment(self, text: str) -> Iterator[bytes]:
        word, going, first = Transducer(self.v), False, 0
        while first < len(text):
            end, goes_on = self._cut(text, first)
            words = self._words(text[first:end])
            last = words.pop() if goes_on else None
            if going:
                part, closed = (words.pop(0), True) if words else (last, not goes_on)
                ids = word.feed(part or "") + (word.close() if closed else [])
                yield np.array(ids, "<u4").tobytes()
                last = last if closed else None
            yield b"".join(map(self.__getitem__, words))
            if last is not None:
                yield np.array(word.feed(last), "<u4").tobytes()
            first, going = end, goes_on

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of ``text``, part by part; special tokens inside it are their own ids."""
        at = 0
        for hit in self.v.specials.finditer(text):
            yield from self._segment(text[at : hit.start()])
            yield self.v.special[hit.group()].to_bytes(4, "little")
            at = hit.end()
        yield from self._segment(text[at:] if at else text)


class Decoder:
    """Text of ids fed in parts. Without ``readable`` it is the library's, which joins the names of tokens by spaces; with
    it the bytes that the names stand for, ends of words as spaces, through an incremental UTF-8 machine."""

    def __init__(self, vocabulary: Vocabulary, readable: bool = False) -> None:
        self.readable, self.names = readable, vocabulary.names
        self.begun = False
        #: Whether some id below the last has no name; such ids are left out.
        self.gaps = not all(self.names)
        if readable:
            byte = {c: b for b, c in enumerate(vocabulary.symbols)}
            end = vocabulary.end
            known = [n[: -len(end)] if end and n.endswith(end) and i not in vocabulary.special.values() else n for i, n in enumerate(self.names)]
            tail = [b" " if n != k else b"" for n, k in zip(self.names, known)]
            self.bytes = [(bytes(byte[c] for c in k) if all(c in byte for c in k) else k.encode()) + t for k, t in zip(known, tail)]
            self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if self.gaps or max(ids, default=0) >= len(self.names):
            ids = [i for i in ids if i < len(self.names) and self.names[i]]
        if self.readable:
            return self.machine.decode(b"".join([self.bytes[i] for i in ids]))
        if not ids:
            return ""
        text = " ".join(map(self.names.__getitem__, ids))
        text, self.begun = " " + text if self.begun else text, True
        return text

    def close(self) -> str:
        self.begun = False
        return self.machine.decode(b"", True) if self.readable else ""


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(vocabulary: str):
    def work(batches):
        encode = encoder(vocabulary).encode
        for batch in text_slices(batches, "text"):
            rows: list[tuple[int | None, int, bool, bytes]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                part, held, size = 0, [], 0
                for ids in encode(text or ""):
                    held.append(ids)
                    size += len(ids)
                    while size >= 4 * PART:
                        whole = b"".join(held)
                        rows.append((doc, part, False, whole[: 4 * PART]))
                        part, held, size = part + 1, [whole[4 * PART :]], size - 4 * PART
                        if len(rows) >= 16:
                            yield _batch(rows)
                            rows = []
                rows.append((doc, part, True, b"".join(held)))
            yield _batch(rows)

    return work


def _batch(rows: list[tuple[int | None, int, bool, bytes]]) -> pa.RecordBatch:
    doc, part, last, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(part, pa.int64()), pa.array(last, pa.bool_()), binary_column(list(ids))], ["doc_id", "part", "last", "ids"])


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, part, last, ids`` of every row of ``docs(doc_id, text)``: little-endian unsigned 32-bit ids.

    A text has one row per ``PART`` ids, at least one, in a row within a partition, ``last`` on its last; so no row and no
    task holds all ids of a very long text. A NULL or empty text is one row without ids; special tokens of the vocabulary
    inside a text are found as the library finds them. Repeated rows are encoded as often as they come, a NULL id is an
    id like any other; other columns are ignored; an empty table gives no rows. Memory beyond a text is bounded as long as
    each ``TILE`` characters hold a space, a number, a run of letters or of punctuation to cut at; other texts take larger tiles.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_encoded(vocabulary), ENCODED)


def _parts(batches) -> Iterator[tuple[int | None, int, bool, list[int]]]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "part", "last", "ids")]
        for doc, part, last, ids in zip(*columns):
            yield doc, part, last, np.frombuffer(ids, "<u4").tolist()


def decoded(tokens: DataFrame, vocabulary: str, readable: bool = False) -> DataFrame:
    """``doc_id, part, last, text`` of ``encoded``'s rows as they come, each text in the parts of its ids."""

    def work(batches):
        machine = Decoder(encoder(vocabulary).v, readable)
        for doc, part, last, ids in _parts(batches):
            text = machine.feed(ids) + (machine.close() if last else "")
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([part]), pa.array([last]), pa.array([text])], ["doc_id", "part", "last", "text"])

    return tokens.mapInArrow(work, "doc_id long, part long, last boolean, text string")


def digests(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encoded``'s rows as they come.

    The digests are of the decimal ids joined by single spaces, and of the decoded text in UTF-8; both are taken part by part.
    """

    def work(batches):
        v = encoder(vocabulary).v
        machine, decimals = Decoder(v), [str(i) for i in range(len(v.names))]
        n, told, text = 0, hashlib.sha256(), hashlib.sha256()
        rows: list[tuple[int | None, int, str, str]] = []

        def out():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for doc, _, last, ids in _parts(batches):
            if ids:
                told.update(((" " if n else "") + " ".join(map(decimals.__getitem__, ids))).encode())
                text.update(machine.feed(ids).encode())
                n += len(ids)
            if last:
                text.update(machine.close().encode())
                rows.append((doc, n, told.hexdigest(), text.hexdigest()))
                n, told, text = 0, hashlib.sha256(), hashlib.sha256()
                if len(rows) >= 2048:
                    yield out()
                    rows = []
        if rows:
            yield out()

    return tokens.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
