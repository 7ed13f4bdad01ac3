"""Texts shared by the tests of this folder."""

import random


def prose(rng, n, kind="en"):
    parts = {"en": ["the", "th", "ing", "er", "on"], "de": ["sch", "ung", "ei", "der", "ß"], "fr": ["eau", "é", "le", "ch", "è"], "es": ["ción", "ñ", "que", "ar", "ó"]}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


_rng = random.Random(7)
SAMPLE = [prose(_rng, 80, kind) for kind in ("en", "de", "fr", "es") for _ in range(4)]
