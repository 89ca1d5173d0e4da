import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, rank string, component string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, clashing column names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    base = " ".join(words * 4)
    rows = [
        (1, base, "en", "a", 10, "x", "y", "z"),
        (2, base, None, "a", 10, None, None, None),
        (3, base.upper(), "en", None, None, "x", "y", "z"),
        (4, None, "en", "a", 10, "x", "y", "z"),
        (5, "", None, None, None, None, None, None),
        (6, " \n\t ", "de", "b", 3, "x", "y", "z"),
        (7, "one two", "de", "b", 7, "x", "y", "z"),
        (7, "one two", "de", "b", 7, "x", "y", "z"),
        (8, "word " * 60_000, "de", "b", 300_000, "x", "y", "z"),
        (9, "été <|endoftext|> \x1c ﬁn 東京 it's", "fr", "b", 1, "x", "y", "z"),
        (None, "no id here at all today", "fr", "c", 5, "x", "y", "z"),
        (None, None, None, None, None, None, None, None),
        (10, "x" * 5_000, "en", "c", 5, "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.xxhash64("text"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
