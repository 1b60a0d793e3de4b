"""Fixtures of the operators' tests: documents with every oddity, no documents."""

import random
from pathlib import Path

import pytest

TESTDATA = Path("/root/testdata")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, `key` int"


def odd_rows():
    """Nulls, empty and blank texts, a very long text, repeated rows, equal ids."""
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "naïve", "straße", "Über", "x1", "don't", "end.", "日本語", "🙂", "a-b"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [
        (100, None, None, None, None),
        (101, "", "en", "s0", 0),
        (102, " \t\n ", "en", "s0", 4),
        (103, "long " * 30_000, "en", "s1", 150_000),
        (104, "w" * 40_000, "en", "s1", 40_000),
        (105, rows[5][1], "en", "s2", None),
        (106, rows[5][1], "en", None, None),
        (7, rows[7][1], "en", "s3", len(rows[7][1])),
        (8, "another text with the id of a row before", "en", "s3", 1),
        (None, "a text without id of four or more words", "de", "s3", 1),
        (None, None, None, None, None),
        (107, "line\nline\n\nline\n other", "en", "", 1),
    ]
    return [(*r, "r", i) for i, r in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
