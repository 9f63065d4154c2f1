"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

CLASHING = ["m", "key", "row", "size", "range", "length", "_id", "_key", "f0", "id", "kept", "domain", "n_tokens", "epoch", "folder", "own", "word", "guest", "_doc", "_bucket"]
LONG = "Reading on and on. " * 3000
ROWS = [
    (5, "The cat sat on the mat.\nIt was happy there, and purred.", "en", "a"),
    (6, "The cat sat on the mat.\nIt was happy there, and purred.", "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \t\n ", "de", None),
    (4, LONG, "en", "b"),
    (None, "A text without an id, of more than a word.", "en", "b"),
    (None, "A text without an id, of more than a word.", "en", "b"),
    (7, "Straße é ​ x\r\ny\x0bz <|endoftext|> end", "de", "a"),
    (8, "repeat", "en", "a"),
    (8, "repeat", "en", "a"),
    (9, "One. Two. Three. " * 40 + "\n" + "One. Two. Three. " * 40, "en", "a"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
