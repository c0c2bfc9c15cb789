import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key int"


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "delta", "über", "naïve", "12", "zeta,", "eta.", "日本", "\U0001f600", "<b>", "it's"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    base, shared = say(120), say(40)
    texts = [None, "", " ", "a", "\n\t", base, base, base + " tail", base.replace("alpha", "omega", 1), say(3), shared + " " + say(30), say(30) + "\n" + shared, say(6000), "x" * 3000, "12345 " * 200, "mail a.b@c.de or +1 (415) 555-0100, card 4111 1111 1111 1111, ip 10.0.0.255", "a@b 999.1.1.1 +12 4111 1111 1111 1112", "\x01" * 150, shared]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), len(t or ""), "z", 1) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id", "en", None, 5, "z", 1)]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
