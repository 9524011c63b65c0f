import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, `class` int, score string, n string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns that clash with results."""
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", None, 5), (None, "no id here", "de", "a", 10),
        (None, None, None, None, None), (4, base, "en", "a", len(base)), (4, base, "en", "a", len(base)),
        (5, base + " tail", "en", "b", 1), (6, base.upper(), "en", "b", 1), (7, "one two three", "en", "b", 1),
        (8, "One  two\nthree", "fr", "c", 1), (9, words(rng, 30_000), "en", "a", 1), (10, "x" * 200_000, "en", "a", 1),
        (11, "é ü 漢字 \U0001f600 <|endoftext|> </s>  double  space\n\n\nend", None, "a", 1), (12, "same " * 3000, "en", "a", 1),
        *[(20 + i, words(rng, rng.randrange(1, 300)), rng.choice(["en", "de", None]), rng.choice("aaaab"), 1) for i in range(40)],
    ]
    return spark.createDataFrame([(*r, "old", 7, "old", "old") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
