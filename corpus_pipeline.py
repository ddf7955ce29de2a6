"""From raw documents to packed training sequences, in five stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chosen_path, column_bwt, mixing, packing, rule_lists
from gridloom.llm.queries import MIXTURE
from gridloom.shared import fresh_path

#: Bytes of words and ids a worker keeps while packing; workers live on through the other stages, which need the memory.
REMEMBERED = 64 << 20
#: Bytes of a repeated string that the suffix stage removes: what 50 short words and the spaces between them take.
PASSAGE = 250
#: Rules are learned, so no SQL gives the rows of ``run``; the tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = rule_lists.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_lists.kept_rows(docs, rules)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles, copies and repeated rows included: the one of the smallest id."""
    return chosen_path.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings of ``PASSAGE`` bytes cover; ``n_chars`` follows."""
    return _measured(column_bwt.cleaned_rows(docs, PASSAGE), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents picked for the target weights, once per epoch they are picked in, the last of a leaf cut to its quota."""
    return _measured(mixing.mixed_rows(docs, MIXTURE), docs)


def _measured(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs`` and ``n_chars``, where it has one, as the text now is."""
    if "n_chars" not in docs.columns:
        return changed.select(*docs.columns)
    return changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, with their ids, and their places in sequences of 4096."""
    pieces = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, remember=REMEMBERED)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mixture),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{number + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
