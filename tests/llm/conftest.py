import random

import pytest

LONG_TABLES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    parts = ["th", "er", "on", "an", "re", "ed", "nd", "ou", "is", "é", "ñ", "sch"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(900)]


@pytest.fixture(scope="session")
def prose(words):
    """prose(seed, n): n words with sentence ends."""

    def make(seed, n):
        rng = random.Random(seed)
        out = []
        for _ in range(n):
            w = rng.choice(words)
            out.append(w + (".\n" if rng.random() < 0.08 else " "))
        return "".join(out).strip()

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """documents([(doc_id, text), ...]) with the other columns, and extra ones with awkward names."""

    def make(rows, more=()):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(d, t, "en", "src", None if t is None else len(t)) for d, t in rows], LONG_TABLES)
        return df.withColumns({c: F.lit("x") for c in more})

    return make
