import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]


@pytest.fixture
def prose(words):
    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    def make(rows):
        full = [(i, t, *(rest or ("en", "s", None if t is None else len(t)))) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd(documents, prose):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows."""
    long = prose(99, 60_000)
    return documents([
        (1, prose(1, 80)), (1, prose(1, 80)), (2, None, None, None, None), (3, "", "en", "s", 0), (None, prose(2, 50), "en", None, None), (None, None, None, None, None),
        (4, " \n\t ", "de", "t", 4), (5, long, "en", "s", len(long)), (6, "word", "en", "t", 4), (7, "Été \U0001f600 你好", "fr", "t", 9), (-(2**63), "least of all ids", "en", "s", 16), (2**63 - 1, "most of all ids", "en", "s", 15),
    ])
