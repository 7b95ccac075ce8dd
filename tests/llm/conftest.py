import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, digest string, size bigint, n bigint"
LETTERS = {"en": "the of and to in is that for", "fr": "le la de et les des une que", "de": "der die und den von zu das mit"}


def make(spark, rows):
    """Documents with further columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None, "x", "y", 7, None) for i, t, lang, src in rows], SCHEMA)


def prose(rng, n, lang="en"):
    words = LETTERS[lang].split()
    return " ".join(rng.choice(words) if rng.random() < 0.4 else "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(n))


#: Nulls, empty and blank texts, repeated rows, ties, one very long text.
def odd_rows():
    rng = random.Random(4)
    long = prose(rng, 6000)
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one two", "en", "a"), (5, "one two", "fr", "b"), (5, "one two", "fr", "b"), (6, long, "en", "b"), (7, "One TWO", "de", "a"), (None, "one two", "en", "a"), (8, "é漢😀 " * 5, None, "ß"), (9, "x" * 20000, "en", "a")]


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, []).cache()
