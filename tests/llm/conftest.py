"""Fixtures of the subpackage's tests."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # extra columns whose names clash with results
        T.StructField("score", T.StringType()),
        T.StructField("rep", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("k0", T.StringType()),
    ]
)
FILLER = "the quick brown fox jumps over the lazy dog while seven wizards watch from afar and say nothing at all"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, FILLER, "en", "a", None, "x", "y", "z", "q"),
        (2, FILLER, None, None, 3, None, None, None, None),
        (2, FILLER, None, None, 3, None, None, None, None),
        (3, None, "fr", "a", 0, None, None, None, None),
        (4, "", "fr", "b", 0, None, None, None, None),
        (5, " \t\n ", "en", "b", 4, None, None, None, None),
        (6, "élan Ünïcode ßtraße token = 'abcdef123' ΑΣ 🙂", "de", "c", 1, None, None, None, None),
        (7, long_text, "en", "c", 1, None, None, None, None),
        (8, "x" * 50_000, "en", "c", 1, None, None, None, None),
        (9, "!!! ### 123", "en", "c", 1, None, None, None, None),
        (None, FILLER + " again", "en", None, 1, None, None, None, None),
        (-5, FILLER.replace("lazy", "sleepy"), "en", "a", 1, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
