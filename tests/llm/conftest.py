import random

import pytest
from sample_texts import prose

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, node long, root long, "
    "cell int, target double, keep_id long, kept boolean, words string, spans string"
)


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns whose names clash with inner ones."""
    return spark.createDataFrame(
        [(i, t, lang, src, None if t is None else len(t), 1, "x", 2, 3, 4, 5.0, 6, False, "w", "s") for i, t, lang, src in rows], SCHEMA
    )


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:-4] + ["changed", "end", "of", "it"])
    return [
        (0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", "a"), (3, long, "en", "a"), (4, long, "en", "b"),
        (5, base, "en", None), (6, base.replace(" ", "\n\n", 3), "en", "b"), (7, near, "de", "b"), (8, "one two", "en", "c"),
        (9, "ONE  two", "en", "c"), (10, "É\x1cñ ß mail me at Ann.B@mail.example.de or +1 (375) 555-4393 now", "xx", "c"), (11, base, "en", "a"),
        (11, base, "en", "a"), (None, "no id here", None, "a"), (None, None, None, None), (12, "Released under the MIT License. MIT license MIT-License; CC BY-NC 4.0", "en", "d"),
    ]


@pytest.fixture(scope="session")
def odd(make, odd_rows):
    return make(odd_rows).cache()


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
