"""Cover density and best-window snippets against plain versions."""

import random

from pyspark.sql import functions as F

from folioscan.operators import lexical, proximity


def covers(words, terms):
    """Shortest stretches with all terms, by looking at every stretch."""
    at = [(i, w) for i, w in enumerate(words) if w in terms]
    full = [(a, b) for a in range(len(at)) for b in range(a, len(at)) if {w for _, w in at[a : b + 1]} == terms]
    least = [(a, b) for a, b in full if not any((x, y) != (a, b) and x >= a and y <= b for x, y in full)]
    return len(least), round(sum(0.1 / (1 + at[b][0] - at[a][0] - (b - a)) for a, b in least), 6)


def test_cover_density_equals_brute_force(spark):
    rng = random.Random(3)
    texts = {i: [rng.choice("alpha beta gamma delta the epsilon zeta".split()) for _ in range(rng.randint(0, 25))] for i in range(60)}
    asked = {1: "alpha", 2: "alpha the beta", 3: "gamma delta alpha alpha", 4: "missing alpha", 5: "the"}
    docs = lexical.tokenised(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()] + [(99, None)], "doc_id long, text string"), "doc_id", F.col("text"))
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query_text string")
    got = {(r.query_id, r.doc_id): (r.covers, r.score) for r in proximity.cover_density(queries, docs, ["the"]).collect()}
    want = {}
    for q, text in asked.items():
        terms = set(text.split()) - {"the"}
        want |= {(q, i): covers(w, terms) for i, w in texts.items() if terms and terms <= set(w)}
    assert got == want and len(want) > 50


def test_cover_density_of_a_long_document(spark):
    words = ("alpha x beta " * 30_000).split()
    docs = lexical.tokenised(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), "doc_id", F.col("text"))
    r = proximity.cover_density(spark.createDataFrame([(1, "alpha beta")], "query_id long, query_text string"), docs, []).first()
    assert r.covers == 59_999 and r.score == round(30_000 * 0.1 / 2 + 29_999 * 0.1, 6)


def window(text, needles, width=8):
    words = text.split()
    bare = ["".join(c for c in w if c.isalnum()).lower() for w in words]
    hits = [i for i, b in enumerate(bare) if b in needles]
    if not hits:
        return None
    kinds = {i: len({bare[j] for j in range(i, min(i + width, len(words))) if bare[j] in needles}) for i in hits}
    first = min(hits, key=lambda i: (-kinds[i], i))
    span = max(j for j in hits if j < first + width) - first + 1
    start = max(0, min(first - (width - span) // 2, len(words) - width))
    shown = [f"<b>{w}</b>" if bare[i] in needles else w for i, w in enumerate(words)][start : start + width]
    return kinds[first], ("…" if start else "") + " ".join(shown) + ("…" if start + width < len(words) else "")


def test_best_window_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["Fox,", "dog", "cat!", "a", "b", "c", "d", "e"]) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(100, None), (101, "fox " + "x " * 3000 + "dog fox.")]
    df = spark.createDataFrame(rows, "i long, text string")
    needles = F.array(*[F.lit(w) for w in ("fox", "dog", "cat")])
    got = {r.i: r.b and (r.b.kinds, r.b.snippet) for r in df.select("i", proximity.best_window(F.col("text"), needles).alias("b")).collect()}
    assert got == {i: window(t or "", {"fox", "dog", "cat"}) for i, t in rows}
