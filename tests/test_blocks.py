"""Matching-block similarity against the standard library's matcher, and on long texts."""

import difflib
import random
import time

from folioscan.functions.blocks import ratio
from folioscan.operators import changes


def edited(rng, text, alphabet, times):
    for _ in range(times):
        p = rng.randint(0, len(text))
        kind = rng.random()
        if kind < 0.4:
            text = text[:p] + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) + text[p:]
        elif kind < 0.8:
            text = text[:p] + text[p + rng.randint(1, 9) :]
        else:
            text = text[p:] + text[:p]
    return text


def test_ratio_equals_plain_matcher():
    """Texts on both sides of 200 characters, small and large alphabets, edits and moves."""
    rng = random.Random(1)
    for _ in range(1000):
        alphabet = rng.choice(["ab", "abc ", "abcdefghijklmnopqrstuvwxyz     ", "aé漢\n "])
        old = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 30, 100, 250, 400, 900])))
        new = edited(rng, old, alphabet, rng.randint(0, 12)) if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 9, 100, 300])))
        want = difflib.SequenceMatcher(None, old, new).ratio()
        assert abs(ratio(old, new) - want) < 1e-12, (old, new)


def test_order_and_inner_changes_count():
    assert ratio("alpha beta gamma", "gamma beta alpha") < 0.8
    assert ratio("abcdefghij" * 3, "abcdefghij" * 3 + "k") > 0.98
    assert ratio(None, "") == 1.0 and ratio("a", None) == 0.0


def test_long_sections_take_nearly_linear_time():
    rng = random.Random(2)
    known = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    words = [rng.choice(known) for _ in range(170_000)]
    old = " ".join(words)
    for _ in range(20):
        words[rng.randrange(len(words))] = "CHANGED"
    start = time.perf_counter()
    assert len(old) > 1_000_000 and 0 < ratio(old, " ".join(words)) < 1
    assert time.perf_counter() - start < 20


def test_plan_compares_modified_sections_only(spark):
    rows = [("a", "modified", "one two three four", "one two 3 four"), ("b", "unchanged", "x", "y"), ("c", "added", None, "z"), ("d", "modified", None, "new")]
    df = spark.createDataFrame(rows, "section_id string, action string, old_content string, new_content string")
    got = {r.section_id: (round(r.similarity, 6), r.reprocess) for r in changes.reprocess_plan(df).collect()}
    want = difflib.SequenceMatcher(None, rows[0][2], rows[0][3]).ratio()
    assert got == {"a": (round(want, 6), want < 0.8), "b": (1.0, False), "c": (0.0, True), "d": (0.0, True)}
