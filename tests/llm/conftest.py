import random

import pytest

LONG = "word%d and then some more of it. "


@pytest.fixture(scope="session")
def prose():
    """Distinct word sequences in an invented language."""

    def make(seed, n, letters="aeioubcdfgklmnprst"):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def messy(spark, prose):
    """Documents with NULLs everywhere, empty and very long texts, ties, repeated rows and clashing columns."""
    long = " ".join(LONG % i for i in range(20_000))
    passage = prose(7, 60)
    rows = [
        (1, "The cat sat on the mat and looked out of the window.\nMenu", "en", "a", 56, "x", "d"),
        (1, "The cat sat on the mat and looked out of the window.\nMenu", "en", "a", 56, "x", "d"),
        (2, "THE CAT sat on the mat and looked out of the window.\nMenu", None, "a", 56, None, "e"),
        (3, None, "en", "a", None, None, None),
        (4, "", "de", None, 0, "y", None),
        (5, "12 34 !!", None, None, None, "y", "f"),
        (None, passage, "fr", "b", 5, "y", "f"),
        (6, prose(1, 40) + " " + passage + " " + prose(2, 40), "fr", "b", None, "y", "f"),
        (7, prose(3, 40) + " " + passage + " " + prose(4, 40), "fr", "b", None, "y", "f"),
        (8, long, "en", "c", len(long), "y", "f"),
        (9, long + "end", "en", "c", len(long), "y", "f"),
        (None, None, None, None, None, None, None),
        (10, "Ünï çödé", "de", "c", 8, "y", "f"),
    ]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, mark string, _d string")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def benchmark(spark, prose):
    words = prose(7, 60).split()
    rows = [(1, " ".join(words[5:25])), (2, "Out, of: THE window"), (3, None), (4, "!!"), (4, ""), (None, "cat sat"), (5, "absent words")]
    return spark.createDataFrame(rows, "item_id long, text string")
