import random

import pytest


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def corpus(spark, sf):
    """(doc_id, text) of the small documents."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of the odd cases: nulls, empty and long texts, repeated rows, clashing column names."""
    long = "word and again " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text of a few words here"), (5, "same text of a few words here"), (6, "same text of a few words here"), (None, "no id at all, but some words"), (7, long), (8, "\u2581 é日本😀\x00")]
    return spark.createDataFrame([(i, t, None, "src", "k", 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, key string, g int, pos int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
