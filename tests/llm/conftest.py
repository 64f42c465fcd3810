import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank texts, ties, repeated rows and one long text."""
    rng = random.Random(1)
    body = words(rng, 120)
    rows = [
        (1, body, "en", "s", 1), (1, body, "en", "s", 1), (2, body, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, " \n\t", "en", "s", 3), (None, body, "en", "s", 1), (None, None, None, None, None),
        (6, "one", "en", "s", 3), (7, "one", "fr", "s", 3), (8, words(rng, 60_000), "en", "s", None), (9, "日本語 テキスト é 👍🏽 <|endoftext|>", "fr", "s", 1), (10, "a@b.example.com", "de", "s", 1), (11, "12345 !!", "en", "s", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    return odd.withColumns({n: F.lit(7) for n in ("n", "rep", "component", "run", "kept", "w", "place", "shingle", "raw", "kind", "norm", "text_key", "band", "h", "gone", "page_id.x")})
