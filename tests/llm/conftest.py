import random

import pytest

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, shard int, key long, set_id long, root long, mean double, name string, at int, copies int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(3)
    long = "\n".join(sentence(rng, 12) for _ in range(900))
    plain = sentence(rng, 80)
    texts = [
        (1, plain), (1, plain), (2, plain), (3, None), (4, ""), (5, " \n\t "), (6, "word"), (7, "Word"),
        (8, long), (9, long + " tail"), (None, plain), (None, None), (10, "\n".join(["same line here"] * 30)),
        (11, "x" * 20_000), (12, "é ü 日本 🙂 " * 30), (8, "another text under a known id " * 10),
    ]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, 7, 1.0, 3, 1, 2, 3, 4.0, "n", 5, 6) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture
def make_docs(spark):
    def make(texts, source=None):
        rows = [(i, t, "en", source[i] if source else "s", 0) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
