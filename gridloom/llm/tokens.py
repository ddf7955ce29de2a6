"""Token ids of whole texts by public tokenizers, each distinct word merged once per worker.

Both vocabularies used here split a text before they merge: around white space, and between letters and the punctuation
after them. A text is cut at such places only, so the ids of its cuts in a row are the ids of the text; cuts repeat, and
what a worker has seen is looked up. Commas and full stops that close a word are cuts of their own, so a word is merged and
remembered once, not again for each sign after it. A cut that is a plain Latin word goes straight to the merges of the
library's model, any other one through the whole tokenizer. Texts with characters that the two regular expression engines
class differently are encoded whole.
"""

from __future__ import annotations

import codecs
import os
import re
import sys

#: Bytes of cuts and their ids that a worker remembers unless told otherwise; it starts anew beyond that.
REMEMBERED = 280 << 20
#: Characters of a cut that is remembered; longer ones rarely come again.
SHORT = 40
#: Characters of a text that is cut at once.
TILE = 1 << 18

#: White space for one engine only, and characters that join or vanish in normal forms across a cut.
_UNSAFE = "\x1c-\x1f\x85\u180e\u200b\u2060\ufeff"
#: Besides these, white space other than a space or line end.
_RARE = re.compile(f"[{_UNSAFE}\t\r\x0b\x0c\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UNSAFE = re.compile(f"[{_UNSAFE}]")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_CUT = re.compile(r"\s*\S+|\s+")
_BREAK = re.compile(r"\S(?=\s)")
#: A word after a space, and what closes it: symbols other than an apostrophe, which may begin a suffix.
_WORD = re.compile(rf"([{_LETTERS}]+)([!-&(-/:-@\[-`{{-~]*(?:\n\S+)?)\Z")
#: Latin-1 bytes by their part in a text: letters and digits, spaces and line ends, signs that close a word, others; tab: any other white space.
_SHAPE = bytes(ord("\t" if _RARE.match(c) or not b else " " if c in " \n" else "," if c in ",." else "a" if re.match(f"[{_LETTERS}0-9]", c) else "*") for b, c in enumerate(map(chr, range(256))))
#: What Python needs for an ASCII string, bytes and their entry besides the characters; a dictionary's own share is some hundred bytes.
_ENTRY = sys.getsizeof("") + sys.getsizeof(b"") + 100


def _byte_letters() -> dict[int, str]:
    """Code points that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The dictionary holds the cuts seen so far: under their text if a space goes before them, else after a NUL.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.room, self.used = REMEMBERED, 0
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Lower-cased words without the space before them.
        self.folds = self.tokenizer.normalizer is not None
        letters = _byte_letters()
        self.letters = "".join(letters[b] for b in range(256))
        self.space = letters[ord(" ")]
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(True))]

    def whole(self, text: str) -> bytes:
        ids = self.ids
        return b"".join([ids[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _merged(self, word: str) -> bytes:
        """Ids of one word, given in the letters of the vocabulary."""
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model.tokenize(word)])

    def __missing__(self, cut: str) -> bytes:
        if cut.isascii() and cut.isalpha():
            # Such letters stand for themselves in the vocabulary.
            found = self._merged(cut.lower() if self.folds else self.space + cut)
        elif cut[:1] == "\0":
            rest = cut[1:]
            plain = rest.isascii() and rest.isalpha()
            found = self._merged(rest.lower() if self.folds else rest) if plain else self.whole(rest)
        elif (parts := _WORD.match(cut)) is None:
            found = self.whole(" " + cut)
        elif not parts[2]:
            word = cut.lower() if self.folds else " " + cut
            found = self._merged(codecs.charmap_decode(word.encode(), "strict", self.letters)[0])
        else:
            found = self[parts[1]] + self["\0" + parts[2]]
        if len(cut) <= SHORT:
            self.used += len(cut) + len(found) + _ENTRY if cut.isascii() else sys.getsizeof(cut) + sys.getsizeof(found) + 100
            if self.used > self.room:
                self.clear()
                self.used = 0
            self[cut] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of ``text``; a long one is encoded in tiles that end before white space."""
        if len(text) <= 2 * TILE or _UNSAFE.search(text) or "\0" in text:
            return self._encode(text)
        parts, first = [], 0
        while first < len(text):
            end = _BREAK.search(text, first + TILE)
            last = end.start() + 1 if end else len(text)
            parts.append(self._encode(text[first:last]))
            first = last
        return b"".join(parts)

    def _encode(self, text: str) -> bytes:
        try:
            shape = text.encode("latin-1").translate(_SHAPE)
        except UnicodeEncodeError:
            shape = b"\t" if _RARE.search(text) else text.encode("latin-1", "replace").translate(_SHAPE)
        if b"\t" in shape and (_UNSAFE.search(text) or "\0" in text):
            return self.whole(text)
        if b"\t" in shape or b"  " in shape or shape[:1] == b" " or shape[-1:] == b" ":
            return b"".join([self["\0" + cut] for cut in _CUT.findall(text)])
        if not (b"*, " in shape or b" , " in shape or b",, " in shape):
            # Every sign before a space or line end closes a word.
            text = text.replace(", ", " \0, ").replace(". ", " \0. ").replace(".\n", " \0.\n \0")
        cuts = text.split(" ")
        cuts[0] = "\0" + cuts[0]
        return b"".join(map(self.__getitem__, cuts))


_encoders: dict[str, Encoder] = {}


def encoder(path: str, remember: int = REMEMBERED) -> Encoder:
    """The worker's encoder for a vocabulary file, remembering up to ``remember`` bytes from now on."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].room = remember
    return _encoders[path]
