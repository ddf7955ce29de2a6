"""DuckDB SQL that the results of clustering and of importance resampling must equal."""

from __future__ import annotations


def clustering_sql(table: str = "embeddings", k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """Centroid clustering, one step of the query per round."""
    parts = [f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, embedding FROM {table}
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
    SELECT r, unnest(range({dims})) AS d, unnest(list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM kept),
starts AS (
    SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c
    FROM kept JOIN (SELECT r, list(x ORDER BY d) AS v FROM cells GROUP BY r) USING (r)),
centres0 AS MATERIALIZED (SELECT c, d, x FROM cells JOIN starts USING (r) WHERE c < {k})"""]  # fmt: skip
    for n in range(rounds + 1):
        parts.append(f"""
near{n} AS MATERIALIZED (
    SELECT r, min(dist) AS distance, arg_min(c, dist * {k} + c) AS c
    FROM (SELECT v.r, m.c, sum((v.x - m.x) * (v.x - m.x)) AS dist FROM cells v JOIN centres{n} m USING (d) GROUP BY v.r, m.c) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""
centres{n + 1} AS MATERIALIZED (
    SELECT c, d, coalesce(new.x, old.x) AS x FROM centres{n} old LEFT JOIN (
        SELECT c, d, CAST(floor_sum // cells_ AS BIGINT) AS x FROM (
            SELECT n.c, v.d, count(*) AS cells_, sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*) AS floor_sum
            FROM near{n} n JOIN cells v USING (r) GROUP BY n.c, v.d)) new USING (c, d))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} n JOIN kept USING (r)
JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM centres{rounds} GROUP BY c) s ON s.c = n.c
"""


def resampling_sql(docs: str = "documents", target: str = "benchmark", buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> str:
    """Importance resampling by single words; CRC-32 is worked out byte by byte for each distinct word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = "regexp_extract_all(translate(coalesce({0}, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (upper, lower)
    step = "CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END"
    return f"""
WITH crc_table AS MATERIALIZED (
    SELECT list(list_reduce(range(8), lambda a, b: {step}, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
rows_ AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words.format("text")} AS w FROM {docs}),
said AS MATERIALIZED (SELECT r, unnest(w) AS word FROM rows_),
wanted AS MATERIALIZED (SELECT unnest({words.format("text")}) AS word FROM {target}),
hashed AS MATERIALIZED (
    SELECT word, list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
            lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT) AS a
    FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM said UNION SELECT word FROM wanted)), crc_table),
buckets_ AS MATERIALIZED (SELECT word, xor(a, 4294967295::BIGINT) % {buckets} AS b FROM hashed),
had AS (SELECT b, count(*) AS s FROM said JOIN buckets_ USING (word) GROUP BY b),
aim AS (SELECT b, count(*) AS t FROM wanted JOIN buckets_ USING (word) GROUP BY b),
gains AS MATERIALIZED (
    SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM said) + {buckets})
        / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {buckets})))) AS BIGINT) AS gain
    FROM had LEFT JOIN aim USING (b)),
weighed AS (
    SELECT r, count(*) AS n, CAST((sum(gain) - ((sum(gain) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS weight
    FROM said JOIN buckets_ USING (word) JOIN gains USING (b) GROUP BY r),
scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
        (CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM rows_ LEFT JOIN weighed USING (r)),
lined AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS place,
        count(*) OVER (PARTITION BY n_features >= {least_words}) AS able
    FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
    CASE WHEN n_features >= {least_words} AND place <= able * {percent} // 100 THEN place END AS rank
FROM lined
"""
