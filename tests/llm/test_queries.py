"""Registered queries on the smallest tables against plain versions, the whole pipeline against brute force, long texts."""

import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe_count, chosen_path, embedding_caps, packing, queries, rule_lists, token_orc, tokens, toxic_crf
from gridloom.shared import fresh_path

from .test_operators import SF, WORD, check_join, check_repeats, components_of, library_ids, plain_counts, texts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_op1(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    m = np.array([r[1] for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    linked = (m @ m.T >= 0.93) & (label[:, None] == label[None, :]) & (label >= 0)
    np.fill_diagonal(linked, False)
    comp = components_of(len(rows), zip(*np.nonzero(np.triu(linked))), [r[0] for r in rows])
    want = sorted((r[0], int(linked[k].sum()), comp[k], r[0] == comp[k]) for k, r in enumerate(rows))
    got = queries.op1_embedding_caps(spark, SF)
    assert got.columns[:4] == ["vec_id", "n_links", "component_id", "kept"] and sorted(map(tuple, got.collect())) == want


def test_embedding_pairs_near_the_threshold_are_found(spark):
    """Planted pairs at a cosine of 0.930 to 0.940 among unrelated vectors; no link is lost."""
    random = np.random.default_rng(4)
    base = random.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = random.normal(size=(600, 64))
    aside -= (aside * base[:600]).sum(axis=1, keepdims=True) * base[:600]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = random.uniform(0.9302, 0.94, (600, 1))
    rows = np.concatenate([base, cosine * base[:600] + np.sqrt(1 - cosine**2) * aside])
    df = spark.createDataFrame([(k, [float(x) for x in v], 1) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r["n_links"] for r in embedding_caps.near_embeddings(df).collect()}
    want = (rows @ rows.T >= 0.93).sum(axis=1) - 1
    assert sum(found.values()) >= 0.99 * want.sum() and want.sum() >= 1200


def test_filters_grow_with_the_rows():
    counts = [embedding_caps.ProductCode(64, rows).words for rows in (10**4, 10**7, 10**8, 10**10)]
    assert counts == sorted(set(counts)) and embedding_caps.ProductCode(1, 10**9).words == 2


def test_op2(spark, docs):
    got = queries.op2_rule_lists(spark, SF)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rules = rule_lists.fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stats = {r["doc_id"]: r for r in rule_lists.text_counts(docs).select("doc_id", *[c.alias(n) for n, c in rule_lists.statistics().items()]).collect()}
    want = []
    for doc, text in texts(docs):
        counts = plain_counts(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        columns = {n: np.array([stats[doc][n]]) for n in rule_lists.statistics()}
        covered = any(bool(rule.covers(columns)[0]) for rule in rules)
        want.append((doc, *counts, failed, not failed and not covered))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rules_judge_documents_they_have_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    all_docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = rule_lists.fit_rules(all_docs, labels.where("doc_id % 3 <> 0"))
    unseen = rule_lists.judged(all_docs, rules).join(labels.where("doc_id % 3 = 0"), "doc_id").where("NOT base_failed").collect()
    assert len(unseen) > 500
    assert sum(r["kept"] == (r["quality"] == 1) for r in unseen) > 0.95 * len(unseen)


def test_op3(spark, docs):
    got = queries.op3_token_orc(spark, SF)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    start, want = 0, []
    for doc, ids in sorted(library_ids("byte_bpe_50k.json", texts(docs), 0)):
        want.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, got.collect())) == want


def _scanned(df):
    """Rows that the file scan of a collected plan gave."""
    df.collect()
    found = []

    def walk(node):
        if node.nodeName().startswith("Scan orc"):
            found.append(node.metrics().get("numOutputRows").get().value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_orc_reads_skip_rows_by_index_and_bloom_filter(spark):
    from pyarrow import orc

    many = spark.range(0, 60_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    path = fresh_path(spark, "test-stripes")
    token_orc.write_token_ids(many.coalesce(1), path, public_tokenizers.path("byte_bpe_50k.json"), stripe_bytes=1 << 16)
    files = sorted(f for f in os.listdir(path) if f.endswith(".orc"))
    read = [orc.ORCFile(os.path.join(path, f)) for f in files]
    assert sum(f.nstripes for f in read) > len(files) and sum(f.nrows for f in read) == 30_000
    # Every stripe is read by itself.
    assert sum(f.read_stripe(k).num_rows for f in read for k in range(f.nstripes)) == 30_000
    stored = spark.read.schema(token_orc.STORED).orc(path)
    assert _scanned(stored.where("doc_id = 31000")) <= 2_000
    assert stored.where("doc_id = 31000").count() == 1
    # Within the range of the ids but in no document: Bloom filters leave fewer rows than the row indexes alone.
    assert _scanned(stored.where("doc_id = 31001")) == 0


def test_op5(spark, docs):
    got = queries.op5_column_bwt(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    rows = got.collect()
    check_repeats(texts(docs), rows, 400)
    assert all(len(r["text"].encode()) <= r["n_bytes"] - r["n_removed"] for r in rows)


def test_op7(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = queries.op7_bpe_count(spark, SF)
    want = [(d, len(t.encode()), len(library.encode(t))) for d, t in texts(docs)]
    assert sorted(map(tuple, got.collect())) == sorted((*w, w[2] > 4096) for w in want)


def check_packed(rows, want, window=4096):
    """Every id of ``want`` (doc_id, bytes) lies in one piece, and sequences have no gaps."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r["doc_id"], r["doc_tokens"])].append((r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc, total), own in pieces.items():
        copies = [ids for d, ids in want if d == doc and len(ids) == 4 * total]
        assert copies and len(own) % len(copies) == 0
        expected = Counter((s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for ids in copies for s, n in {(a, b) for a, b, _ in own})
        assert all(expected[p] for p in own)
        assert sum(n for _, n, _ in own) == total * len(copies)
    assert sum(len(ids) for _, ids in want) == 4 * sum(r["length"] for r in rows)
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= window


def test_op8(spark, docs):
    got = queries.op8_packing(spark, SF)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_packed(got.collect(), library_ids("word_bpe_49k.json", texts(docs), 2))


def test_op9(spark, docs):
    check_join(texts(docs), queries.op9_chosen_path(spark, SF).collect())


def test_runs_follow_from_the_recall():
    assert chosen_path.runs_for(0.8, 0.9999) < chosen_path.runs_for(0.3, 0.9999) and chosen_path.runs_for(0.3, 0.999999) > 64
    assert len({int(chosen_path._seed(run)) for run in range(500)}) == 500


def test_planted_pairs_just_similar_enough_are_linked(spark):
    """400 pairs at a Jaccard of 0.816 and 0.844; no link is lost."""
    rng = np.random.default_rng(7)
    rows, want = [], 0
    for k in range(400):
        words = [f"{k}x{j}" for j in rng.permutation(300)]
        # One word replaced takes five shingles out and puts five in; n of them give (296 - 5n) / (296 + 5n).
        n = 5 + k % 2
        at = 20 + 40 * np.arange(n)
        other = [f"o{j}" if j in at else w for j, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want += 2
    got = chosen_path.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.groupBy().sum("n_links").first()[0] == want


def test_second_tokens_split_large_buckets(spark, monkeypatch):
    """Sets of which all share a third of their tokens, and twenties another third."""
    monkeypatch.setattr(chosen_path, "BUCKET", 6)
    rng = np.random.default_rng(1)
    base = [f"b{j}" for j in range(60)]
    rows = []
    for k in range(120):
        words = [*base, *[f"{k // 20}g{j}" for j in range(60)], *[f"{k // 2}y{j}" for j in range(60)]]
        rows.append((k, " ".join(words if k % 2 == 0 else [*words[:-1], "z"])))
    rng.shuffle(rows)
    rows = [(int(k), str(t)) for k, t in rows]
    check_join(rows, chosen_path.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_op10(spark, docs):
    got = queries.op10_toxic_crf(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    chain = toxic_crf.fit_chain(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    tagger = toxic_crf.Tagger(chain) if chain else None
    known = dict(texts(docs))
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(known)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        p = [q for _, q in tagger.marginals(known[r["doc_id"]])] if chain else []
        score = chain.score(max(p, default=0.0), sum(p)) if chain else 0.0
        assert r["predicted"] == (r["score"] >= 0.5)


def test_every_cue_is_trained_on_wherever_it_stands(spark):
    """A sure cue that only comes late, after many other cue words, gets a weight."""
    rng = np.random.default_rng(3)
    plain = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(240):
        words = [str(w) for w in rng.choice(plain, 400)]
        if k % 4 == 0:
            words[:120:12] = [f"vile{j}" for j in range(10)]
            words[350] = "zorgle"
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxic_crf.fit_chain(table, table.select("doc_id", "toxic"), per_text=2)
    assert chain.weights["=zorgle"] > 0.5


def test_op12_and_op13_have_sql():
    assert {"op4_mixing", "op12_importance_radix", "op13_centroid_tables"} <= set(queries.ORACLES)


def plain_quotas(tokens_by_leaf, mixture):
    """Budgets down the tree by filling the children that fall short first, dealing the rest by weight."""

    def deal(budget, children):
        left = sorted(children, key=lambda c: (c[2] / c[1], c[0]))
        weights = sum(c[1] for c in left)
        used, quotas, short = 0, {}, []
        for name, weight, capacity in left:
            if capacity * weights <= weight * (budget - used):
                quotas[name] = capacity
                short.append(name)
            used += capacity
            weights -= weight
        rest, total = budget - sum(quotas.values()), sum(w for n, w, _ in left if n not in short)
        upto = 0
        for name, weight, _ in left:
            if name not in short:
                quotas[name] = rest * (upto + weight) // total - rest * upto // total
                upto += weight
        return quotas

    weight = lambda level, name: mixture.weights.get(level, {}).get(name, 1)
    capacity = {leaf: n * mixture.max_epochs for leaf, n in tokens_by_leaf.items()}
    budget = min(sum(tokens_by_leaf.values()) * mixture.budget_percent // 100, sum(capacity.values()))
    result = {}
    over = lambda key: sum(c for leaf, c in capacity.items() if leaf[: len(key)] == key)
    for domain, q in deal(budget, [(d, weight("domain", d), over((d,))) for d in {x[0] for x in capacity}]).items():
        langs = {x[1] for x in capacity if x[0] == domain}
        for lang, r in deal(q, [(n, weight("lang", n), over((domain, n))) for n in langs]).items():
            sources = {x[2] for x in capacity if x[:2] == (domain, lang)}
            for source, s in deal(r, [(n, weight("source", n), over((domain, lang, n))) for n in sources]).items():
                result[domain, lang, source] = s
    return result


def leaf_of(row):
    number = re.search(r"([0-9]{1,9})$", row["source"] or "")
    return (f"domain{int(number[1]) % 4}" if number else "other", row["lang"] or "(none)", row["source"] or "(none)")


def test_pipeline_stage_by_stage_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    passage = " ".join(f"wd{k}" for k in range(10, 65))
    extra = [(10_000 + k, f"planted {k} " + " ".join(f"own{k}w{j}" for j in range(120)) + " " + passage + f" tail {k}", "en", f"src{k % 3}", 0) for k in range(6)]
    table = table.unionByName(spark.createDataFrame(extra, table.schema)).withColumn("epoch", F.lit("kept"))
    rules = rule_lists.fit_rules(table, spark.read.parquet(f"{sf}/labels.parquet"))
    stats = {(r["doc_id"], r["tx"]): r for r in rule_lists.judged(table, rules).select("doc_id", "kept", F.lit(0).alias("tx")).collect()}
    # 1: base rules by plain counts; what the learned list adds is the query's own test.
    kept = stage["quality rules"](spark, table, sf)
    assert kept.columns == table.columns
    first = {r["doc_id"]: r for r in table.collect()}
    for doc, row in first.items():
        c = plain_counts(row["text"] or "")
        if c[0] < 10 or 100 * c[4] > 20 * c[0]:
            assert not stats[doc, 0]["kept"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for (d, _), r in stats.items() if r["kept"])
    # 2: groups by brute force, the smallest id of each stays.
    rows = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (WORD.findall(t.encode()) for _, t in rows)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    comp = components_of(len(rows), pairs, [d for d, _ in rows])
    joined = stage["n-gram Jaccard join"](spark, kept, sf)
    assert sorted(r["doc_id"] for r in joined.collect()) == sorted({c if s else d for c, s, (d, _) in zip(comp, sets, rows)})
    # 3: bytes covered by repeated strings of 250 bytes; passages of over 50 short words are among them.
    own = joined.collect()
    seen = Counter(b[k : k + 250] for b in ((r["text"] or "").encode() for r in own) for k in range(len(b) - 249))
    want = Counter()
    for r in own:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 249):
            if seen[b[k : k + 250]] > 1:
                gone[k : k + 250] = True
        want[(r["doc_id"], bytes(c for c, g in zip(b, gone) if not g).decode(errors="ignore"))] += 1
    cleaned = stage["suffix-array dedup"](spark, joined, sf)
    kinds = lambda df: [(f.name, f.dataType) for f in df.schema]
    assert kinds(cleaned) == kinds(table)
    assert Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned.collect())
    assert 250 <= len(passage.encode()) < 400
    assert all(passage not in t and "own0w5 " * (d == 10_000) in t for (d, t) in want if d >= 10_000)
    # 4: every leaf's words are its quota, whole epochs first, one document cut to a prefix of its words.
    before = cleaned.collect()
    tokens_of = lambda text: len(WORD.findall((text or "").encode()))
    size = Counter()
    for r in before:
        size[leaf_of(r)] += tokens_of(r["text"])
    quotas = plain_quotas(dict(size), queries.MIXTURE)
    mixed = stage["mixing sources to target weights"](spark, cleaned, sf)
    assert kinds(mixed) == kinds(table)
    after = mixed.collect()
    got = Counter()
    for r in after:
        got[leaf_of(r)] += tokens_of(r["text"])
    assert +got == +Counter(quotas)
    told = {(r["doc_id"], r["text"]): r for r in before}
    times = Counter((r["doc_id"], r["text"]) for r in after)
    cut = [r for r in after if (r["doc_id"], r["text"]) not in told]
    assert max(Counter(map(leaf_of, cut)).values(), default=0) <= 1
    for r in cut:
        assert any(d == r["doc_id"] and t.startswith(r["text"]) for d, t in told)
    for (doc, text), row in told.items():
        epochs = quotas[leaf_of(row)] // size[leaf_of(row)] if size[leaf_of(row)] else 0
        assert epochs <= times[doc, text] <= epochs + 1 or not text
    # 5: every token of what is left lies in one piece.
    packed = stage["packing"](spark, mixed, sf)
    assert packed.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = packed.collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in pieces)
    library = library_ids("word_bpe_49k.json", [(r["doc_id"], r["text"] or "") for r in after], 2)
    assert sum(r["length"] for r in pieces) == sum(len(b) // 4 for _, b in library)
    whole = Counter()
    for r in pieces:
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert whole == Counter({k: v * k[1] for k, v in Counter((d, len(b) // 4) for d, b in library).items()})


def _peak(code):
    """Megabytes a fresh process needs beyond its start for a 30 MB text ``t``."""
    head = "import resource, sys; sys.path.insert(0, '.'); import numpy as np, pyarrow as pa, public_tokenizers as P\n"
    text = "t = ' '.join('w%dx%d' % (k % 9973, k % 977) for k in range(3_400_000)); assert 25e6 < len(t) < 36e6\n"
    tail = "\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - r) // 1024)"
    setup, work = code
    run = subprocess.run([sys.executable, "-c", head + setup + text + "r = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n" + work + tail], capture_output=True, text=True, check=True)
    return int(run.stdout.split()[-1])


@pytest.mark.parametrize(
    "code",
    [
        ("from gridloom.llm import tokens\ne = tokens.Encoder(P.path('byte_bpe_50k.json'))\n", "e.encode(t)"),
        ("from gridloom.llm import bpe_count\nc = bpe_count.Counter(P.path('piece_bpe_32k.model'))\n", "c.count(t)"),
        ("from gridloom.llm import words\nd = lambda: np.frombuffer(t.encode(), np.uint8)\n", "x = d(); words.shingle_sets(x, np.array([0, len(x)]))"),
    ],
    ids=["token ids", "token counts", "shingles"],
)
def test_a_text_of_thirty_megabytes_takes_less_than_five_hundred(code):
    assert _peak(code) < 500


def test_caches_are_bounded_by_bytes():
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.room = 200_000
    rng = np.random.default_rng(2)
    for _ in range(300):
        encoder.encode("".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 9000, 1000)))
        encoder.encode(" ".join(f"w{int(c)}" for c in rng.integers(0, 10**6, 200)))
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) + 100 for k, v in encoder.items())
    assert held <= 200_000 and max(map(len, encoder)) <= tokens.SHORT
    counter = bpe_count.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    counter.count("abc " * 10 + "x" * 5000)
    assert max(map(len, counter)) <= bpe_count.SHORT


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_is_merged_once_whatever_closes_it(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    words = [f"{a}{b}{c}ward" for a in "bcdf" for b in "aeiouéü" for c in "lmnr"]
    text = " ".join(f"{w} {w}, {w}. {w}.\nThen" for w in words) + " end"
    encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder) < len(words) + 10
    # Signs that are part of what stands before them, other white space, characters beyond Latin-1, NUL.
    rng = np.random.default_rng(4)
    parts = np.array(["the", "Wörd", "ß", "42", " ", " ", " ", "\n", ", ", ". ", ".\n", ",", ".", "..", "%%%", "\n\n", "'s", "!", "µ", "½", "\u0301", "“", "œ", "日本", "\u2003", "\x85", "\0", "\t"])
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)).tolist())
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_tiles_change_nothing(monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "TILE", 40)
    monkeypatch.setattr(bpe_count, "TILE", 40)
    rng = np.random.default_rng(9)
    pieces = np.array(["the", " ", "  ", "\n", "\t", "word", "▁", "é", "日本語", "'s", "1", "42", ".", " a", "x" * 60, "<|endoftext|>", "</s>"])
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counter = bpe_count.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder, library = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        for _ in range(300):
            text = "".join(rng.choice(pieces, rng.integers(1, 120)))
            if encoder.letters and "<|endoftext|>" in text and name == "byte_bpe_50k.json":
                text = text.replace("<|endoftext|>", "")
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
            assert counter.count(text) == len(model.encode(text))


def test_span_hashes_of_long_data(monkeypatch):
    from gridloom.llm import words

    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[rng.random(5000) < 0.01] = 32
    starts, ends, _ = words.word_spans(data, np.array([0, 5000]))
    whole = words.SpanHash(data)(starts, ends)
    monkeypatch.setattr(words, "TILE", 64)
    assert (words.span_hashes(data, starts, ends) == whole).all()


def test_packing_a_long_text(spark):
    docs = spark.createDataFrame([(1, "wörd 12 " * 80_000), (2, "a b")], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(docs, path, 2).selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    check_packed(got, library_ids("word_bpe_49k.json", texts(docs), 2))


def test_many_buckets_at_once(monkeypatch):
    """Buckets of all sizes, cut into batches anywhere: the edges connect what a plain search of each bucket connects."""
    import pyarrow as pa

    from gridloom.llm import batches, links

    rng = np.random.default_rng(6)
    sizes = [1, 2, 3, 12, 13, 40, 1, 200, 5] * 6
    key = np.repeat(np.arange(len(sizes)), sizes)
    ids, value = rng.permutation(len(key)), rng.integers(0, 30, len(key))
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(value)], ["k", "id", "v"])
    cuts = [0, *sorted(rng.integers(0, len(key), 25).tolist()), len(key)]
    parts = [whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
    got = []
    for table, starts in batches.whole_runs(parts, ["k"], 50):
        v = np.asarray(table["v"])
        assert starts[0] == 0 and starts[-1] == table.num_rows
        got += links._forest(batches.longs(table, "id"), starts, lambda i, others, v=v: v[others] == v[i]).tolist()
    # Rows of one bucket with equal values form a group.
    want = {frozenset(ids[(key == k) & (value == v)].tolist()) for k in range(len(sizes)) for v in set(value[key == k].tolist())}
    comp = components_of(len(ids), got, list(range(len(ids))))
    groups = defaultdict(set)
    for k, c in enumerate(comp):
        groups[c].add(k)
    assert {frozenset(g) for g in groups.values()} == want
