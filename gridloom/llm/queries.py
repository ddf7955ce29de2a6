"""Registered queries of the operators, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import (
    bpe_count, bpe_stream, centroid_tables, chat_prefix, chosen_path, column_bwt, embedding_caps, importance_radix, mixing, packing, rule_lists,
    token_orc, toxic_crf,
)
from gridloom.llm.oracle_sql import clustering_sql, resampling_sql
from gridloom.shared import fresh_path

#: Weights of the demonstration mixture: uneven enough that some leaves fall short and repeat.
MIXTURE = mixing.Mixture(
    weights={
        "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
        "lang": {"en": 3, "de": 3, "fr": 2, "es": 2},
        "source": {"src0": 1, "src1": 4, "src2": 3, "src3": 2, "src4": 5},
    },
    max_epochs=3,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_caps.near_embeddings(_table(spark, sf_dir, "embeddings"))


def op2_rule_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = rule_lists.fit_rules(docs, _table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rule_lists.judged(docs, rules).select(*columns)


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    token_orc.write_token_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_orc.with_checksums(token_orc.read_token_ids(spark, path))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), MIXTURE)


def op5_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = column_bwt.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


def op6_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    said = r"\### Assistant: </turn> ok"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    path, shown = fresh_path(spark, "chat"), fresh_path(spark, "chat-examples")
    chat_prefix.formatted_turns(turns.unionByName(tricky)).write.parquet(path)
    segments = spark.read.parquet(path)
    chat_prefix.examples(segments).write.parquet(shown)
    return chat_prefix.digests(segments, spark.read.parquet(shown))


def op7_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.ngram_join(_table(spark, sf_dir, "documents"))


def op10_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxic_crf.fit_chain(docs, _table(spark, sf_dir, "labels"))
    return toxic_crf.scored(docs, chain).select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op11_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe_stream.digests(bpe_stream.encoded(_table(spark, sf_dir, "documents"), vocabulary), vocabulary)


def op12_importance_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_radix.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_centroid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_tables.clustered(_table(spark, sf_dir, "embeddings")).drop("centroid")


def _case(level: str, table: str = "") -> str:
    arms = " ".join(f"WHEN {table}{level} = '{name}' THEN {w}" for name, w in sorted(MIXTURE.weights.get(level, {}).items()))
    return f"CAST(CASE {arms} ELSE 1 END AS BIGINT)"


def _deal(source: str, family: str, name: str) -> str:
    """SQL of one level: source has budget b, capacity c, weight w; adds quota q."""
    line = f"PARTITION BY {family} ORDER BY CAST(c AS DOUBLE) / w, {name}"
    return f"""(SELECT *, CASE WHEN short THEN c ELSE
            (rest * up_to) // nullif(total, 0) - (rest * (up_to - w)) // nullif(total, 0) END AS q
        FROM (SELECT *, b - sum(CASE WHEN short THEN c ELSE 0 END) OVER (PARTITION BY {family}) AS rest,
                sum(CASE WHEN short THEN 0 ELSE w END) OVER (PARTITION BY {family}) AS total,
                sum(CASE WHEN short THEN 0 ELSE w END) OVER ({line} ROWS UNBOUNDED PRECEDING) AS up_to
            FROM (SELECT *, c * open <= w * (b - used) AS short
                FROM (SELECT *, coalesce(sum(c) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                        sum(w) OVER (PARTITION BY {family})
                            - coalesce(sum(w) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
                    FROM {source}))))"""


def mixing_sql(table: str = "documents") -> str:
    """The mixture in DuckDB SQL: every pick, with the part of it inside the quota."""
    m = MIXTURE
    return f"""
WITH rows_ AS (
    SELECT doc_id, coalesce(lang, '{m.missing}') AS lang, coalesce(source, '{m.missing}') AS source,
        CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
            ELSE 'domain' || (CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) END AS domain,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, md5(coalesce(text, '')) AS tx
    FROM {table}),
leaves AS (
    SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {m.max_epochs} AS c, {_case("source")} AS w
    FROM rows_ GROUP BY ALL),
tops AS (SELECT domain, 0 AS family, sum(c) AS c, {_case("domain")} AS w,
        least((SELECT sum(tokens) FROM leaves) * {m.budget_percent} // 100, (SELECT sum(c) FROM leaves)) AS b
    FROM leaves GROUP BY domain),
domains AS (SELECT domain, q FROM {_deal("tops", "family", "domain")}),
langs_in AS (SELECT l.domain, l.lang, sum(l.c) AS c, {_case("lang", "l.")} AS w, any_value(d.q) AS b
    FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, l.lang),
langs AS (SELECT domain, lang, q FROM {_deal("langs_in", "domain", "lang")}),
leaves_in AS (SELECT l.*, g.q AS b FROM leaves l JOIN langs g USING (domain, lang)),
plan AS (SELECT domain, lang, source, q AS quota, CASE WHEN tokens > 0 THEN q // tokens ELSE 0 END AS epochs,
        CASE WHEN tokens > 0 THEN q % tokens ELSE 0 END AS rest
    FROM {_deal("leaves_in", "domain, lang", "source")}),
placed AS (SELECT r.*, p.*EXCLUDE (domain, lang, source),
        md5('{m.seed}:' || (epochs + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || tx) AS place
    FROM rows_ r JOIN plan p USING (domain, lang, source)),
line AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place ROWS UNBOUNDED PRECEDING) - n_tokens AS begins
    FROM placed WHERE rest > 0)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens,
    CAST(n_taken AS BIGINT) AS n_taken, CAST(quota AS BIGINT) AS quota
FROM (SELECT doc_id, domain, lang, source, unnest(range(1, CAST(epochs AS BIGINT) + 1)) AS epoch, n_tokens, n_tokens AS n_taken, quota
        FROM placed WHERE epochs > 0
    UNION ALL SELECT doc_id, domain, lang, source, epochs + 1, n_tokens, least(n_tokens, rest - begins), quota FROM line WHERE begins < rest)
"""


QUERIES = {f.__name__: f for f in (
    op1_embedding_caps, op2_rule_lists, op3_token_orc, op4_mixing, op5_column_bwt, op6_chat_prefix, op7_bpe_count, op8_packing,
    op9_chosen_path, op10_toxic_crf, op11_bpe_stream, op12_importance_radix, op13_centroid_tables,
)}
ORACLES = {"op4_mixing": mixing_sql(), "op12_importance_radix": resampling_sql(), "op13_centroid_tables": clustering_sql()}
