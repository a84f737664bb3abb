from __future__ import annotations

import re

import pytest

ODD = [
    (1, "One two three four five six seven.", "en", "a"),
    (1, "One two three four five six seven.", "en", "a"),  # a repeated row
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "  \n\t ", "de", ""),
    (None, "ONE two three four five six seven.", None, "b"),
    (5, "wort " * 30_000, "de", "b"),
    (6, "über é 漢字 🙂 #*$ 12345678", "de", None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, shard string, key string, row int, node string, bits double"


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, empty and very long texts, repeated rows, and extra columns named like inner ones."""
    return spark.createDataFrame([r + ("x", "y", 1, "z", 0.5) for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")
