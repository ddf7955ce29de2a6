"""Operators against brute force, the libraries, and round trips; odd rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from gridloom.llm import bpe_count, chat_prefix, chosen_path, column_bwt, embedding_caps, mixing, packing, queries, rule_lists, token_orc, toxic_crf
from gridloom.shared import fresh_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def components_of(n, pairs, ids):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[max(root(i), root(j), key=lambda k: ids[k])] = min(root(i), root(j), key=lambda k: ids[k])
    return [ids[root(k)] for k in range(n)]


def check_join(rows, got):
    known = [(d, t) for d, t in rows if d is not None]
    sets = []
    for _, t in known:
        w = WORD.findall(t.encode())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    links = Counter(k for p in pairs for k in p)
    comp = components_of(len(known), pairs, [d for d, _ in known])
    want = sorted((d, links[k], comp[k], d == comp[k]) for k, (d, _) in enumerate(known))
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert all((r["n_links"], r["kept"]) == (0, True) for r in got if r["doc_id"] is None)
    assert len(got) == len(rows)


def test_ngram_join(spark, odd_docs, no_docs):
    check_join(texts(odd_docs), chosen_path.ngram_join(odd_docs).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_join(texts(docs), chosen_path.ngram_join(docs).collect())
    assert chosen_path.ngram_join(no_docs).count() == 0


def test_ngram_join_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET", 8)
    base = [f"t{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:k % 200], f"u{k}", *base[k % 200 + 1 :]])) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_join(rows, chosen_path.ngram_join(docs).collect())


def test_ngram_join_tells_texts_of_one_id_apart(spark):
    words = [[f"{c}{k}" for k in range(100)] for c in "abcdef"]
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    rows = [(5, " ".join(w)) for w in words] + [(10 + k, near(w, 50)) for k, w in enumerate(words)] + [(3, near(words[4], 2)), (5, " ".join(words[0])), (None, " ".join(words[1]))]
    check_join(rows, chosen_path.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def check_repeats(rows, got, length):
    seen = Counter(b[k : k + length] for b in (t.encode() for _, t in rows) for k in range(len(b) - length + 1))
    want = []
    for doc, text in rows:
        b, steps = text.encode(), np.zeros(len(text.encode()) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                steps[k] += 1
                steps[k + length] -= 1
        gone = np.cumsum(steps[:-1]) > 0
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((doc or -1, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)


@pytest.mark.parametrize("crowd", [1 << 14, 2])
def test_repeats(spark, odd_docs, no_docs, crowd):
    rows = [r for r in texts(odd_docs) if len(r[1]) < 10_000]
    short = odd_docs.where("text is null or length(text) < 10000")
    check_repeats(rows, column_bwt.without_repeats(short, 200, crowd).collect(), 200)
    passage = " ".join(f"p{k}" for k in range(60))
    mixed_in = [(k, f"{'x' * (k % 7)} a{k} " + (passage[k % 3 :] if k % 2 else "") + f" tail {k * k}" + (passage if k % 5 == 0 else "")) for k in range(40)]
    docs = spark.createDataFrame(mixed_in, "doc_id long, text string")
    check_repeats(mixed_in, column_bwt.without_repeats(docs, 150, crowd).collect(), 150)
    assert column_bwt.without_repeats(no_docs).count() == 0


def test_cleaned_rows_keep_columns(odd_docs):
    cleaned = column_bwt.cleaned_rows(odd_docs)
    assert cleaned.columns == odd_docs.columns
    assert cleaned.count() == odd_docs.count()
    assert cleaned.where("doc_id = 6").select("text").distinct().collect()[0][0] == ""


def test_embeddings(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(30, 24))
    rows = [(k, [float(x) for x in centres[k % 30] + random.normal(size=24) * random.choice([0.05, 0.25, 0.4])], k % 3) for k in range(400)]
    rows += [(400 + k, rows[k][1], rows[k][2]) for k in range(20)] + [(3, rows[3][1], rows[3][2])]
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, rows[0][1], None), (903, [float("nan")] + [1.0] * 23, 1), (904, [None] + [1.0] * 23, 1), (None, rows[0][1], 0), (905, [1.0, 2.0], 1), (906, [], 1)]
    df = spark.createDataFrame([(*r, "bucket") for r in rows + odd], "vec_id long, embedding array<double>, label int, id string")
    got = embedding_caps.near_embeddings(df).collect()
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (m @ m.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    comp = components_of(len(rows), zip(*np.nonzero(np.triu(linked))), [r[0] for r in rows])
    want = sorted((r[0], int(linked[k].sum()), comp[k], r[0] == comp[k]) for k, r in enumerate(rows))
    assert sorted(tuple(r) for r in got if r["vec_id"] is not None and r["vec_id"] < 900) == want
    assert sorted(tuple(r) for r in got if r["vec_id"] is not None and r["vec_id"] >= 900) == sorted((o[0], 0, o[0], True) for o in odd if o[0])
    assert len(got) == len(rows) + len(odd)
    assert embedding_caps.near_embeddings(df.limit(0)).count() == 0


def test_embeddings_tell_vectors_of_one_id_apart(spark):
    random = np.random.default_rng(8)
    m = random.normal(size=(6, 24))
    rows = [(5, v, 0) for v in m] + [(10 + k, v + random.normal(size=24) * 0.05, 0) for k, v in enumerate(m)] + [(3, m[4] * 1.5, 0), (5, m[0], 0)]
    df = spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in rows])
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    comp = components_of(len(rows), zip(*np.nonzero(np.triu(linked))), [r[0] for r in rows])
    want = sorted((r[0], int(linked[k].sum()), comp[k], r[0] == comp[k]) for k, r in enumerate(rows))
    assert sorted(tuple(r) for r in embedding_caps.near_embeddings(df).collect()) == want


def plain_counts(text):
    b = text.encode()
    words = WORD.findall(b)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + i for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for i in range(5)}
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(b.count(c) for c in b"#*$%&|<>"), dup, len(covered)


def test_text_counts(spark, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = rule_lists.text_counts(docs).collect()
        want = sorted((d if d is not None else -1, *plain_counts(t)) for d, t in texts(docs))
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *r[1:6]) for r in got) == want
    assert rule_lists.text_counts(no_docs).count() == 0


def test_rules_reject_what_they_learned(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = rule_lists.fit_rules(docs, labels)
    rows = rule_lists.judged(docs, rules).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) > 0.97 * len(rows)
    kept = rule_lists.kept_rows(odd_docs, rules)
    assert kept.columns == odd_docs.columns
    assert kept.count() == rule_lists.judged(odd_docs, rules).where("kept").count()
    assert rule_lists.fit_rules(no_docs, labels.limit(0)) == []
    random = np.random.default_rng(1)
    x, y = random.random(2000), random.random(2000)
    bad = (x > 0.7) & (y < 0.4)
    found = rule_lists.learn_rules({"x": x, "y": y}, bad, np.arange(2000) % 3 == 0)
    covered = np.any([r.covers({"x": x, "y": y}) for r in found], axis=0)
    assert (covered == bad).mean() > 0.97


def library_ids(name, rows, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [(d, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()) for d, t in rows]


def test_token_orc(spark, odd_docs, no_docs):
    path = fresh_path(spark, "test-orc")
    token_orc.write_token_ids(odd_docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(token_orc.with_checksums(token_orc.read_token_ids(spark, path)).collect(), key=lambda r: r["start"])
    want = library_ids("byte_bpe_50k.json", texts(odd_docs), 0)
    key = lambda d: -1 if d is None else d
    assert [key(r["doc_id"]) for r in got] == sorted(key(d) for d, _ in want)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert sorted((key(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((key(d), len(b) // 4, zlib.crc32(b)) for d, b in want)
    some = token_orc.read_token_ids(spark, path).where("doc_id = 6")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 3
    empty = fresh_path(spark, "test-orc")
    token_orc.write_token_ids(no_docs, empty, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_orc.read_token_ids(spark, empty).count() == 0


def test_packing(spark, odd_docs, no_docs):
    got = packing.packed(odd_docs, public_tokenizers.path("word_bpe_49k.json"), 2, lot=20_000, remember=5_000).collect()
    want = library_ids("word_bpe_49k.json", texts(odd_docs), 2)
    whole = Counter()
    taken = set()
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and 0 <= r["offset"] <= 4096 - r["length"]
        slots = {(r["sequence_id"], k) for k in range(r["offset"], r["offset"] + r["length"])}
        assert not slots & taken
        taken |= slots
        whole[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert whole == Counter({k: v * k[1] for k, v in Counter((d, len(b) // 4) for d, b in want).items()})
    pieces = {(r["doc_id"], r["start"]): r["ids"] for r in got if r["doc_id"] is not None}
    for doc, ids in want:
        if doc is not None:
            assert b"".join(bytes(b) for (d, _), b in sorted(pieces.items()) if d == doc) == ids
    sequences = Counter(s for s, _ in taken)
    assert all(sorted(o for s, o in taken if s == q)[-1] == n - 1 for q, n in sequences.items())
    assert packing.packed(no_docs, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit_decreasing([6, 5, 4, 3, 2], 10) == [(0, 0), (1, 0), (0, 6), (1, 5), (1, 8)]
    random = np.random.default_rng(5)
    lengths = random.integers(1, 101, 500).tolist()
    places, room = packing.best_fit_decreasing(lengths, 100), {}
    for k in sorted(range(500), key=lambda k: (-lengths[k], k)):
        fits = [c for c in room.values() if c >= lengths[k]]
        window, offset = places[k]
        assert offset == 100 - room.get(window, 100)
        assert (room[window] == min(fits)) if fits and lengths[k] < 100 else window not in room
        room[window] = room.get(window, 100) - lengths[k]


def test_token_counts(spark, odd_docs, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = bpe_count.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
        want = [(d if d is not None else -1, len(t.encode()), len(library.encode(t))) for d, t in texts(docs)]
        assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in got) == sorted(want)
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert bpe_count.token_counts(no_docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", "b\\"), (1, 1, "us:er", None), (1, None, None, "x####</turn>y"), (1, 3, "assistant", ""), (1, 3, "assistant", ""), (None, 1, "assistant", "é\n😀")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    segments = chat_prefix.formatted_turns(turns)
    got = {r["conv_id"]: r for r in chat_prefix.digests(segments).collect()}
    for conv in (-7, 1, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
        loss = [x for _, r, x in own if r == "assistant"]
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(own), sha(f"{r}\n{x}\n" for _, r, x in own))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (sum(map(len, loss)), sha(loss))
    written = chat_prefix.example_texts(segments).collect()
    refs = {(r["conv_id"], r["place"]): r for r in chat_prefix.examples(segments).collect()}
    assert len(written) == len(refs) == 5
    for r in written:
        ref = refs[(r["conv_id"], r["place"])]
        assert ref["context_chars"] <= ref["reply_from"] <= ref["reply_to"] <= len(r["text"]) and r["text"].endswith("</turn>\n")
    assert chat_prefix.formatted_turns(turns.limit(0)).count() == 0


def test_chat_query_writes_and_reads_its_examples(spark, monkeypatch):
    paths = {}

    def noted(session, name):
        paths[name] = fresh_path(session, name)
        return paths[name]

    monkeypatch.setattr(queries, "fresh_path", noted)
    got = {r["conv_id"]: r for r in queries.op6_chat_prefix(spark, SF).collect()}
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    replies = Counter(c for c, _, r, _ in turns if r == "assistant")
    segments, shown = spark.read.parquet(paths["chat"]), spark.read.parquet(paths["chat-examples"])
    assert Counter(r["conv_id"] for r in shown.collect()) == replies
    lengths = Counter()
    for r in chat_prefix.example_texts(segments).collect():
        lengths[r["conv_id"]] += len(r["text"])
    for conv, r in got.items():
        own = sorted((t if t is not None else -1, role or "", x or "") for c, t, role, x in turns if c == conv)
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"], r["example_chars"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest(), lengths[conv])
    # The masks come from the examples, and a context that the segments do not have is noticed.
    assert chat_prefix.digests(segments, shown.limit(0)).groupBy().sum("loss_chars").first()[0] == 0
    with pytest.raises(Exception, match="names another context"):
        chat_prefix.digests(segments, shown.selectExpr("conv_id", "place", "context_turns", "context_chars + 1 AS context_chars", "reply_from", "reply_to")).collect()


def test_mixing(spark, odd_docs, no_docs):
    con = duckdb.connect()
    con.register("documents_odd", odd_docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for docs, table in ((odd_docs, "documents_odd"), (spark.read.parquet(f"{SF}/documents.parquet"), "documents")):
        got = mixing.mixed(docs, queries.MIXTURE)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.mixing_sql(table)})").fetchall()
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))
    assert mixing.mixed(no_docs, queries.MIXTURE).count() == 0


def test_quotas_hold_with_equal_and_null_ids(spark):
    words = lambda n, k: " ".join(f"w{k}" for _ in range(n))
    rows = [(None, words(144, k), "en", "a") for k in range(50)] + [(k % 20, words(30 + k, k), "en", "b") for k in range(60)]
    rows += [(7, words(11, 0), "de", "b")] * 40 + [(8, "", "de", "b")] * 3 + [(9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for percent, epochs in ((37, 1), (40, 3), (100, 2), (3, 1), (230, 5)):
        mixture = mixing.Mixture(weights={"source": {"a": 5}, "lang": {"de": 2}}, budget_percent=percent, max_epochs=epochs)
        taken, quotas = Counter(), {}
        for r in mixing.mixed(docs, mixture).collect():
            leaf = (r["domain"], r["lang"], r["source"])
            taken[leaf] += r["n_taken"]
            quotas[leaf] = r["quota"]
            assert 0 <= r["n_taken"] <= r["n_tokens"]
        assert taken == quotas, (percent, taken, quotas)
        cut = Counter()
        for r in mixing.mixed_rows(docs, mixture).collect():
            cut[(r["lang"] or "(none)", r["source"] or "(none)")] += len((r["text"] or "").split())
        assert cut == Counter({k[1:]: v for k, v in quotas.items()})


def test_mixed_rows_keep_their_columns(spark):
    """Columns named like the operator's own, rows that share an id in two leaves, and rows equal in every column."""
    schema = "doc_id long, text string, lang string, source string, epoch string, _order int, quota int, tx string"
    rows = [(k, f"text {k} " * 10, "en", f"src{k % 2}", "e", k, None, "x") for k in range(20)]
    rows += [(k, f"other {k} " * 10, "de", f"src{k % 2}", "e", None, 1, "x") for k in range(20)] + [(3, "same " * 9, "en", "src1", None, 1, 1, None)] * 6
    docs = spark.createDataFrame(rows, schema)
    mixture = mixing.Mixture(weights={"lang": {"en": 3}}, max_epochs=2, budget_percent=60)
    got = mixing.mixed_rows(docs, mixture)
    assert got.schema == docs.schema
    whole = Counter(rows)
    picked = Counter(tuple(r) for r in got.collect())
    cut = [r for r in picked if r not in whole]
    assert len(cut) <= 4 and all(any(w[1].startswith(r[1]) and w[0] == r[0] and w[2:] == r[2:] for w in rows) for r in cut)
    assert all(n <= 2 * whole[r] for r, n in picked.items() if r in whole)
    assert mixing.mixed_rows(docs.limit(0), mixture).count() == 0


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 5), ("b", "x", "4", 1000)], "domain string, lang string, source string, tokens long")
    quotas = {r["source"]: r["quota"] for r in mixing.leaf_quotas(leaves, mixing.Mixture(max_epochs=1, budget_percent=40)).collect()}
    # 806 tokens, 403 a domain; y can use 5, so x has 398, of which source 1 can use 10.
    assert quotas == {"1": 10, "2": 388, "3": 5, "4": 403}


def test_marginals_equal_enumeration():
    chain = toxic_crf.Chain({"=bad": 3.0, "bad": 0.5, "=odd": -1.0}, frozenset(), -2.0, ((0.3, -0.4), (-0.2, 0.6)))
    words = ["x", "bad", "y", "z", "odd", "bad", "x"]
    emit = [chain.bias + sum(chain.weights.get(f, 0) for f in toxic_crf.features(w)) for w in words]
    total, toxic = 0.0, np.zeros(len(words))
    for code in range(2 ** len(words)):
        states = [(code >> k) & 1 for k in range(len(words))]
        weight = np.exp(sum(e for e, s in zip(emit, states) if s) + sum(chain.moves[a][b] for a, b in zip(states, states[1:])))
        total += weight
        toxic += weight * np.array(states)
    got = toxic_crf.Tagger(chain).marginals(" ".join(words))
    assert [k for k, _ in got] == [1, 4, 5]
    np.testing.assert_allclose([p for _, p in got], (toxic / total)[[1, 4, 5]], rtol=1e-9)


def test_toxicity_held_out(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxic_crf.fit_chain(docs, labels)
    rows = toxic_crf.scored(docs, chain).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) > 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and (r["spans"] or not r["predicted"]) for r in rows)
    assert toxic_crf.scored(odd_docs, chain).count() == odd_docs.count()
    assert toxic_crf.fit_chain(no_docs, labels.limit(0)) is None
    assert {r["score"] for r in toxic_crf.scored(odd_docs, None).collect()} == {0.0}
    assert toxic_crf.scored(no_docs, chain).count() == 0


def test_pipeline(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, SF)
    joined = stage["n-gram Jaccard join"](spark, kept, SF)
    assert joined.columns == docs.columns
    groups = chosen_path.ngram_join(kept).where("kept").select("doc_id").collect()
    assert sorted(r[0] for r in joined.select("doc_id").collect()) == sorted(r[0] for r in groups)
    cleaned = stage["suffix-array dedup"](spark, joined, SF)
    assert cleaned.schema == docs.schema and cleaned.count() == joined.count()
    mixed_docs = stage["mixing sources to target weights"](spark, cleaned, SF)
    picks = mixing.mixed(cleaned, queries.MIXTURE)
    assert mixed_docs.schema == docs.schema
    assert sum(len(WORD.findall((r["text"] or "").encode())) for r in mixed_docs.collect()) == picks.groupBy().sum("n_taken").first()[0]
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.groupBy().sum("length").first()[0] == stage["packing"](spark, mixed_docs, SF).groupBy().sum("length").first()[0]


def test_pipeline_keeps_one_document_of_each_group(spark):
    import corpus_pipeline

    words = [[f"{c}{k}" for k in range(150)] for c in "abcdef"]
    a, b, c, d, e, f = (" ".join(w) for w in words)
    near = " ".join([*words[3][:70], "other", *words[3][71:]])
    # Repeated rows; a NULL id beside a NULL id; a clean text under the id of a removed near copy; a NULL id beside an id.
    rows = [(1, a, "x"), (1, a, "y"), (1, a, "x"), (None, b, "x"), (None, b, "x"), (2, d, "x"), (3, near, "x"), (3, c, "x"), (None, e, "x"), (4, e, "x"), (5, f, "x")]
    rows += [(None, None, "x"), (None, None, "x"), (6, "", "x"), (7, "", "x")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    joined = stage["n-gram Jaccard join"](spark, docs, SF)
    assert joined.schema == docs.schema
    want = [(1, a, "x"), (None, b, "x"), (2, d, "x"), (3, c, "x"), (4, e, "x"), (5, f, "x"), *rows[-4:]]
    assert Counter(tuple(r)[:3] for r in joined.collect()) == Counter(want)
    cleaned = stage["suffix-array dedup"](spark, joined, SF)
    assert Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == Counter((i, t or "") for i, t, _ in want)
