"""The streaming encoder against the library, its lookahead against continuations, and the decoder."""

import hashlib
import random
import resource

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe_stream, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return bpe_stream.Encoder(PATH)


def ids(encoder, text):
    return np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()


def wanted(library, text):
    found = library.encode(text, add_special_tokens=False).ids
    decoded = library.decode(found, skip_special_tokens=False)
    return len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_every_plain_character(library, ours):
    for c in map(chr, range(0x300)):
        for text in (c, f"a{c}b", f"{c}s", f"1{c}", f"'{c}", f"{c}'s", f"A{c}{c} x"):
            assert ids(ours, text) == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_tiles_and_words_without_end(library, ours, monkeypatch):
    monkeypatch.setattr(bpe_stream, "TILE", 64)
    rng = random.Random(4)
    odd = [*map(chr, [*range(32, 0x180), *range(0x300, 0x370), *range(0x1100, 0x1200), *range(0xAC00, 0xAC20), *range(0x1F600, 0x1F620)]), *"İΣς\x1c\x85 ​क़"]
    kinds = ["abcdest'ehr", "!=-'#%", "日本語中文ab", "0123456789a", odd]
    for k in range(400):
        text = "".join(rng.choice(kinds[k % 5]) for _ in range(rng.randint(1, 2000)))
        assert ids(ours, text) == library.encode(text, add_special_tokens=False).ids, text[:80]
    for word in ("ha", "😂", "the", "er", "é", "한", "a"):
        text = word * 3000 + "x<|endoftext|>ok<|startoftext|>"
        assert ids(ours, text) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_settles_tokens(ours):
    v = ours.v
    rng = random.Random(5)
    parts = [t.replace(v.end, "") for t in v.ids if t.replace(v.end, "").isascii() and t.replace(v.end, "").isalpha()]
    for _ in range(150):
        head = [v.symbols[b] for b in "".join(rng.choice(parts) for _ in range(500)).encode()]
        tails = [[v.symbols[b] for b in "".join(rng.choice(parts) for _ in range(8)).encode()] for _ in range(3)] + [[]]
        settled = set()
        for tail in tails:
            whole, done, inside = head + tail, 0, []
            whole = whole[:-1] + [whole[-1] + v.end]
            for token in v.merged(whole):
                done += v.size[token]
                if done > len(head) - v.lookahead:
                    break
                inside.append(token)
            settled.add(tuple(inside))
        assert len(settled) == 1 and len(settled.pop()) > 10


def test_lookahead_is_the_longest_chain():
    size = {"a": 1, "b": 1, "c": 1, "bc": 2, "abc": 3}
    assert bpe_stream.lookahead([], size) == 2
    assert bpe_stream.lookahead([("b", "c")], size) == 2
    # c after b takes b, which takes a: two symbols, and the last one's own form.
    assert bpe_stream.lookahead([("b", "c"), ("a", "bc")], size) == 3


def test_transducer_holds_a_bounded_number_of_symbols(ours):
    word, most = bpe_stream.Transducer(ours.v), 0
    rng = random.Random(6)
    for _ in range(300):
        word.feed("".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 3000))))
        most = max(most, len(word.held))
    assert most < 2 * ours.v.window


def test_merges_out_of_order_are_refused(tmp_path):
    import json

    told = json.load(open(PATH))
    told["model"]["merges"] = told["model"]["merges"][::-1]
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps(told))
    with pytest.raises(ValueError, match="before its parts"):
        bpe_stream.Vocabulary(str(bad))


def test_readable_text(ours):
    v = ours.v
    for text in ("hello wörld 日本 it's 12", "naïve 😀"):
        machine, found = bpe_stream.Decoder(v, readable=True), ids(ours, text)
        got = "".join(machine.feed([i]) for i in found) + machine.close()
        assert got.replace(" ", "") == text.replace(" ", "")


def test_rows(spark, odd_docs, no_docs, library, monkeypatch):
    got = bpe_stream.digests(bpe_stream.encoded(odd_docs, PATH), PATH).collect()
    want = [(-1 if r["doc_id"] is None else r["doc_id"], *wanted(library, r["text"] or "")) for r in odd_docs.collect()]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)
    assert bpe_stream.encoded(no_docs, PATH).count() == 0
    assert bpe_stream.digests(bpe_stream.encoded(no_docs, PATH), PATH).count() == 0


def test_a_long_text_takes_several_rows(spark, library):
    text = "wörd 12 " * 60_000
    docs = spark.createDataFrame([(1, "a"), (2, text), (3, None)], "doc_id long, text string").coalesce(1)
    tokens = bpe_stream.encoded(docs, PATH)
    rows = tokens.collect()
    assert [(r["doc_id"], r["part"], r["last"]) for r in rows if r["doc_id"] != 2] == [(1, 0, True), (3, 0, True)]
    assert sum(r["doc_id"] == 2 for r in rows) > 3 and max(len(r["ids"]) for r in rows) <= 4 * bpe_stream.PART
    found = np.frombuffer(b"".join(r["ids"] for r in rows if r["doc_id"] == 2), "<u4").tolist()
    assert found == library.encode(text, add_special_tokens=False).ids
    told = "".join(r["text"] for r in bpe_stream.decoded(tokens, PATH).collect() if r["doc_id"] == 2)
    assert told == library.decode(found, skip_special_tokens=False)
    assert bpe_stream.digests(tokens, PATH).where("doc_id = 2").first()[1:] == wanted(library, text)


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_bpe_stream(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((d, *wanted(library, t or "")) for d, t in docs)


def test_thirty_megabytes_without_a_space_stay_small(ours):
    text = "abcdefghij" * 3_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = sum(len(part) for part in ours.encode(text)) // 4
    assert n > 3_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_a_decoder_leaves_out_ids_without_a_name():
    from types import SimpleNamespace

    from gridloom.llm import bpe_stream

    for names in (["a", "", "c"], ["a", "b", "c"]):
        machine = bpe_stream.Decoder(SimpleNamespace(names=names))
        assert machine.gaps == ("" in names)
        assert [machine.feed(part) for part in ([0, 1], [], [7, 2])] == [" ".join(filter(None, names[:2])), "", " c"]
