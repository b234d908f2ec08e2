"""Rows and tables that the tests of this folder share."""

import os
import random

import pytest

SF_SMALL, SF_CHECK = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
os.environ["TOKENIZERS_PARALLELISM"] = "false"
LONG = " ".join(random.Random(5).choice(["the", "a", "of", "été", "x1", "日本"]) for _ in range(40_000))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, LONG), (5, LONG), (6, "x" * 30_000), (7, "one two three\n\none two three"), (8, "one two three\n\none two three"),
    (None, "one two three four"), (None, None), (9, "\x00 zero 😀 ▁ <|endoftext|> </s>"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Rows with nulls, empty and long texts, repeated rows, ties, and extra columns that are named like inner ones."""
    rows = [(i, t, "en", "src", 0 if t is None else len(t), 1, "k", [1]) for i, t in EDGE]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id int, `key` string, base_ array<int>"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 0, 0), (7, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
