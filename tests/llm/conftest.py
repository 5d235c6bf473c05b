from __future__ import annotations

import random

import pytest

from tests.llm import tables


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names
    the operators use inside."""
    return spark.createDataFrame(tables.ODD, tables.SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], tables.SCHEMA)


@pytest.fixture(scope="session")
def word_docs(spark):
    """Random word sequences with copies and near copies; and the same as a list."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(120):
        if k % 3 and rows:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 40, 80]))]
        rows.append((k, " ".join(words), "en", f"src{k % 5}", 1, 0.5, 1, "x"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, tables.SCHEMA), rows
