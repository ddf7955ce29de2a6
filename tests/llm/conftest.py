import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.StringType()), T.StructField("component", T.StringType())])

LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
BASE = " ".join(f"word{k}" for k in range(120))
ODD_TEXTS = [
    None, "", " \n\t ", "one", "one two three four", "a b c d e", BASE, BASE, BASE + " and more", BASE.replace("word7 ", "other "),
    LONG, LONG, "é à ü 日本 😀 \x00 \x1c x\x85y", "  lead\n\n trail  ", "a<|endoftext|>b </s> <unk> ▁▁ x", "same line\nsame line\nsame line\n",
]


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and names that operators use themselves."""
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, None, "x", "y") for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[6], rows[6], (None, BASE, None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
