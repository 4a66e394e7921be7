"""Tables and fixtures of these tests; test modules import the fixtures they use."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

from starloom.llm.queries import with_library

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def library(spark: SparkSession) -> None:
    with_library(spark)


@pytest.fixture(scope="session")
def prose() -> list[str]:
    """Repeatable texts of made-up words."""
    draw = random.Random(5)
    syllables = ["ta", "ri", "mon", "el", "sta", "ou", "ver", "lin", "ke", "dor"]
    words = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(400)]

    def sentence() -> str:
        return " ".join(draw.choices(words, k=draw.randint(6, 14))).capitalize() + "."

    return ["\n".join(" ".join(sentence() for _ in range(3)) for _ in range(draw.randint(3, 8))) for _ in range(40)]


@pytest.fixture(scope="session")
def odd_docs(spark: SparkSession, prose: list[str]):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators add."""
    long = " ".join(prose * 60)
    rows = [
        (1, None, "en", None), (2, "", None, "a"), (3, " \n\t ", "en", "a"), (4, prose[0], "en", "a"),
        (4, prose[0], "en", "a"), (5, prose[0], "fr", "b"), (None, prose[1], "en", "b"), (7, long, "en", "b"),
        (8, "one", None, None), (9, prose[2], None, "a"), (None, None, None, None), (11, "mail jo.2@a.example.org", "en", "a"),
        (12, "é é \U0001f600 中文", "zh", "a"),
    ]
    rows = [(i, t, la, s, len(t or ""), 7.0, "x", [1], "y") for i, t, la, s in rows]
    names = "score double, kept string, pii array<int>, sequence_id string"
    return spark.createDataFrame(rows, f"{DOCS}, {names}")
