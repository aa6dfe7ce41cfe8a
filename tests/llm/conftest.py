import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _node string, kept string"


def words(seed, n, k=400):
    r = random.Random(seed)
    return [f"w{r.randrange(k)}" for _ in range(n)]


def odd_rows():
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    base = " ".join(words(1, 80))
    near = base.replace(base.split()[40], "changed", 1)
    rows = [
        (1, base, "en", "a", 1), (2, near, "en", "a", 1), (3, None, "en", "a", None), (4, "", "de", None, 0), (5, " \n\t ", None, "b", 3),
        (None, "no id here at all", "en", "a", 2), (None, "no id here at all", "en", "a", 2), (7, "one two", None, None, None), (7, "other text", "fr", "c", 1),
        (8, base, "en", "a", 1), (9, base, None, "z", 1), (9, base, None, "z", 1), (10, " ".join(words(2, 30_000)), "en", "long", 9), (11, "<|endoftext|> é🙂 x", "es", "a", 4),
        (12, "same line\nsame line\nsame line", "en", "a", 3),
    ]
    return [(*r, "clash", "clash") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
