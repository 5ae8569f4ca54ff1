"""Small fixtures with nulls, ties, repeats, long texts and clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß漢 ") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, rows[3][1]), (104, rows[3][1]), (104, rows[3][1]), (None, "a null id"), (None, None)]
    rows += [(110, "Word " * 30_000), (111, "x" * 50_000), (112, rows[5][1] + " more"), (113, "I'm we'll 12345 ...  \n\n end")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
