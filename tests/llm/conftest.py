import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, th string, starts int, row_key int, `a.b` int"


def prose(n, seed, size=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}x" for _ in range(n))


def rows(texts, first=0):
    return [(first + i, t, "en", "s", None if t is None else len(t), "k", "t", i, 1, 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """A function: documents of these texts, with columns of clashing names."""
    return lambda texts, first=0: spark.createDataFrame(rows(texts, first), SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a missing doc_id."""
    long = prose(60_000, 7, 10**6)
    some = rows([None, "", "  \n", "one", prose(80, 1), prose(80, 1), long, "日本 語 text"], 10)
    none = (None, prose(70, 3), None, None, None, None, None, None, None, None)
    return spark.createDataFrame(some + [some[4], some[0], none, none], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows_: spark.createDataFrame(rows_, "doc_id long, quality int, toxic int")
