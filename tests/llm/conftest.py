from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and extra columns with names that clash."""
    long_text = " ".join(f"word{i % 977} the" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0, 5),
        (2, "", "en", None, 0, 5),
        (3, " \t\n\x0b\x0c\r ", None, "a", 7, 5),
        (4, "one two three", "en", "b", None, None),
        (5, "the same text said twice over and over", "en", "b", 1, 5),
        (5, "the same text said twice over and over", "en", "b", 1, 5),
        (6, "the same text said twice over and over", "en", "\U0001f600", 1, 5),
        (None, "a text without an id but with words", "en", "￿", 1, 5),
        (7, long_text, "en", "a", 1, 5),
        (8, "é" * 5000, "fr", "a", 1, 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
