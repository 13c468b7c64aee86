import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, lexicon):
    return " ".join(rng.choice(lexicon) for _ in range(n))


@pytest.fixture(scope="session")
def lexicon():
    rng = random.Random(5)
    return ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 8))) for _ in range(800)]


@pytest.fixture(scope="session")
def make(spark):
    """documents rows from (id, text) pairs, with columns whose names operators use inside."""

    def build(pairs):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCS)
        return df.selectExpr("*", "'x' AS k", "7 AS d", "'y' AS node", "0 AS shard", "1 AS n_lines", "'z' AS score", "array(1) AS w")

    return build


@pytest.fixture(scope="session")
def odd(make, lexicon):
    """Null and empty texts, a null id, repeated rows, one id with two texts, a very long text, odd characters."""
    rng = random.Random(6)
    long_text = "\n".join(words(rng, 60, lexicon) for _ in range(400))
    base = words(rng, 80, lexicon)
    return make([(1, None), (2, ""), (3, " \t\n \n"), (None, base + " end"), (4, base), (4, base), (4, base + " tail more"), (5, long_text), (6, "İß ÀÉ  x\u0000y \U0001f600"), (7, base.upper())])


@pytest.fixture(scope="session")
def none(make):
    return make([])
