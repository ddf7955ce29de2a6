"""Importance resampling and centroid clustering against plain versions and their SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridloom.llm import centroid_tables, importance_radix, queries
from gridloom.llm.oracle_sql import clustering_sql, resampling_sql

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_resampling(rows, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    found = [(d, *features(t)) for d, t in rows]
    have, want = Counter(b for _, _, f in found for b in f), Counter(b for t in target for b in features(t)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for d, n_words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((n_words, (d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))))))
    able = sorted((r for n, r in out if n >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = len(able) * percent // 100
    ranked = [(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return sorted(ranked + [(*r, None) for n, r in out if n < least], key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("block", "longest"), [(importance_radix.BLOCK, 1), (7, 2)])
def test_resampling(spark, odd_docs, no_docs, block, longest):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    goal = [r["text"] for r in target.collect()]
    long_words = spark.createDataFrame([(70 + k % 3, "Ab " * (30 + k % 5) + "x" * (k % 2)) for k in range(40)] + [(-(2**62), "ok " * 25), (2**62 + 5, "ok " * 25)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(long_words)
    got = importance_radix.resampled(docs, target, longest=longest, percent=60, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == plain_resampling(pairs(docs), goal, longest, percent=60)
    assert importance_radix.resampled(no_docs, target).count() == 0
    assert importance_radix.resampled(odd_docs, target.limit(0)).count() == odd_docs.count()


def test_resampling_query(spark):
    rows = pairs(spark.read.parquet(f"{SF}/documents.parquet"))
    goal = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op12_importance_radix(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resampling(rows, goal)


def test_resampling_sql_on_odd_rows(spark, odd_docs):
    con = duckdb.connect()
    con.register("odd", odd_docs.where("text is null or length(text) < 10000").select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    got = importance_radix.resampled(odd_docs.where("text is null or length(text) < 10000"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sorted(map(repr, con.execute(resampling_sql("odd")).fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_words_across_tiles(monkeypatch):
    monkeypatch.setattr(importance_radix, "TILE", 16)
    text = ("Word " * 20 + "x" * 100 + " é! 12-ab").encode()
    index = importance_radix.Buckets(1000)
    parts = list(index.of(text, 3))
    words = WORD.findall(text.decode().translate(LOWER))
    want = Counter(zlib.crc32(" ".join(words[k : k + n]).encode()) % 1000 for n in (1, 2, 3) for k in range(len(words) - n + 1))
    assert sum(n for n, _ in parts) == len(words) and Counter(np.concatenate([f for _, f in parts]).tolist()) == want


def test_radix_pass_is_stable(spark):
    rows = spark.createDataFrame([(k // 10, k % 10, k, 3 if k % 3 else k % 2) for k in range(100)], "block long, at long, k long, d int")
    got = importance_radix.radix_pass(rows, rows["d"], 16).collect()
    order = sorted(range(100), key=lambda k: 3 if k % 3 else k % 2)
    assert [r["k"] for r in sorted(got, key=lambda r: r["at"])] == order
    assert all(r["block"] == r["at"] // 16 for r in got)


def plain_clusters(rows, k=40, rounds=5, seed=2, dims=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = np.array([v for _, v in order[:k]], object).reshape(-1, dims)
    m = np.array([v for _, v in kept], object).reshape(-1, dims)
    for n in range(rounds + 1):
        dist = np.array([[int(((x - c) ** 2).sum()) for c in centres] for x in m])
        near = dist.argmin(axis=1) if len(m) else []
        if n < rounds:
            for c in range(len(centres)):
                own = m[near == c]
                if len(own):
                    centres[c] = [int(s) // len(own) for s in own.sum(axis=0)]
    least = [int(dist[r, c]) for r, c in enumerate(near)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, int(c), d, sum(e for e, o in zip(least, near) if o == c), sum(least), sha[c]) for (i, _), c, d in zip(kept, near, least)), key=repr)


def test_clusters(spark):
    random = np.random.default_rng(2)
    rows = [(k, [float(x) for x in random.normal(size=64) * random.choice([0.1, 2, 300])]) for k in range(120)]
    rows += [rows[5], rows[5], (5, rows[6][1]), (None, rows[7][1]), (None, [0.0] * 64), (200, [0.0] * 64), (201, [-0.001] * 64)]
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] + [1.0] * 63), (306, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, cluster string, distance int")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, centroid_tables.clustered(df).select(columns).collect()), key=repr) == plain_clusters(rows)
    few = df.where("vec_id < 7")
    assert sorted(map(tuple, centroid_tables.clustered(few).select(columns).collect()), key=repr) == plain_clusters([r for r in rows if r[0] is not None and r[0] < 7])
    assert centroid_tables.clustered(df.limit(0)).count() == 0
    assert centroid_tables.clustered(df.where("vec_id >= 300")).count() == 0
    huge = spark.createDataFrame([(k, [1e300 * (-1) ** k] + [0.0] * 63) for k in range(50)], "vec_id long, embedding array<double>")
    assert centroid_tables.clustered(huge, k=1).count() == 50


def test_clusters_sql_on_odd_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT vec_id % 90 AS vec_id, embedding FROM '{SF}/embeddings.parquet' UNION ALL SELECT NULL, embedding FROM '{SF}/embeddings.parquet' WHERE vec_id = 4")
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    df = df.selectExpr("vec_id % 90 AS vec_id", "embedding").union(df.where("vec_id = 4").selectExpr("CAST(NULL AS LONG)", "embedding"))
    got = centroid_tables.clustered(df).drop("centroid").collect()
    assert sorted(map(repr, con.execute(clustering_sql()).fetchall())) == sorted(repr(tuple(r)) for r in got)


def test_clusters_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op13_centroid_tables(spark, SF)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows)


def test_nearest_takes_the_smaller_number():
    vectors, centres = np.array([[0, 0], [4, 0]]), np.array([[2, 0], [2, 0], [4, 1]])
    assert [x.tolist() for x in centroid_tables.nearest(vectors, centres)] == [[0, 2], [4, 1]]
