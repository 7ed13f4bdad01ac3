"""Importance resampling, cover-tree search and collocations against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sample_texts import prose

from folioscan.llm import collocations, cover_tree, importance
from folioscan.llm.common import numbered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text):
    w = re.findall(WORD, lower(text))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampling(rows, target):
    docs = [(d, *features(t)) for d, t, *_ in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, _, fs in docs for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * float(S + 10000) / ((s[b] + 1) * float(T + 10000)))) for b in s}
    out = []
    for d, n, fs in docs:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_of_odd_rows(make, odd_rows, spark, nothing):
    rng = random.Random(21)
    rows = odd_rows + [(100 + i, prose(rng, rng.randint(0, 60)), None, "a") for i in range(150)] + [(5000, "W" * 700 + " É9 " + "z" * 65, None, None)]
    target = [prose(rng, 30, "de"), None, "", prose(rng, 200)]
    goal = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, score long")
    got = sorted((tuple(r) for r in importance.resampled(make(rows), goal).collect()), key=str)
    assert got == resampling(rows, target) and sum(r[4] is not None for r in got) >= 5
    assert importance.resampled(nothing, goal).count() == 0
    assert importance.resampled(make(rows), goal.limit(0)).count() == len(rows)
    drawn = importance.selected(make(rows), goal)
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r[0] for r in got if r[4] is not None)


def test_bit_planes_give_exact_weights():
    rng = np.random.default_rng(3)
    gains = rng.integers(-(10**6), 10**6, importance.BUCKETS)
    for top in (0, 1, 5, 10**9):
        counts = rng.integers(0, top + 1, importance.BUCKETS) * (rng.random(importance.BUCKETS) < 0.1)
        assert importance.Gains(gains).weight(counts) == sum(int(c) * int(g) for c, g in zip(counts, gains, strict=True))


def test_checksums_of_runs():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc AB.é-9 \n") for _ in range(rng.randint(0, 200))) for _ in range(200)] + ["x" * 500 + " y " + "z" * 200, "", "a"]
    sizes, runs = importance.buckets([t.encode() for t in texts])
    for text, size, end in zip(texts, sizes, np.cumsum(sizes), strict=True):
        own = np.concatenate([r[end - size : end] for r in runs])
        assert sorted(own[own >= 0].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in features(text)[1])


def test_numbered_places_ties_and_nulls(spark):
    rows = [(i % 7, None if i % 5 == 0 else i) for i in range(200)]
    got = numbered(spark.createDataFrame(rows, "a int, b int"), [F.desc("a"), F.asc_nulls_last("b")], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 201))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def nearest(rows, every, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(whole):
        if q % every == 0:
            found = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for j, (i, w) in enumerate(whole) if j != at and len(w) == len(v)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    """Clusters, one vector shared by many rows, odd and broken vectors, repeated ids, other lengths."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * (0.01 if i % 6 else 1)).astype(np.float32).tolist()) for i in range(500)]
    rows += [(1000 + i, [0.25] * 8) for i in range(150)]
    rows += [(2000, None), (2050, []), (2100, [1.0, None] + [0.0] * 6), (2150, [float("nan")] * 8), (2200, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    rows += [(2250, [1.0, 2.0]), (2251, [3.0, -1.0]), (2300, [0.5] * 3), (50, [0.25] * 8), (2350, [30000.0] * 8), (-50, [-1.5] * 8)]
    return rows


def test_search_equals_brute_force(spark, vectors, monkeypatch):
    """With blocks and leaves small enough that trees branch and blocks are pruned."""
    for name, value in (("QUERY_BLOCK", 1), ("DATA_BLOCK", 8), ("QUERY_LEAF", 4), ("DATA_LEAF", 8)):
        monkeypatch.setattr(cover_tree, name, value)
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, label int, row long, cell int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in cover_tree.top_products(df).collect())
    assert got == nearest(rows, 50, 5)
    assert sorted(tuple(r) for r in cover_tree.top_products(df, F.col("vec_id") % 7 == 0, 3).collect()) == nearest(rows, 7, 3)
    assert cover_tree.top_products(df.limit(0)).count() == 0


def test_trees_cover_and_prune():
    """Every point lies within its nodes' radii; close groups are decided with few products."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 4000
    v = np.rint(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    tree = cover_tree.Tree(v, 64)
    for low, high, centre, radius in zip(tree.low, tree.high, tree.centres, tree.radius, strict=True):
        assert np.linalg.norm(tree.vectors[low:high] - centre, axis=1).max() <= radius + 1e-6
    queries = cover_tree.Tree(v[:200], 16)
    best = cover_tree.Best(np.full(200, cover_tree.NONE), 5)
    ids = np.arange(4000)
    products = cover_tree.search(queries, ids[:200][queries.order], tree, ids[tree.order], ids[tree.order], best)
    assert products < 0.3 * 200 * 4000
    scores = v[:200][queries.order] @ v.T
    for i, own in enumerate(queries.order):
        scores[i, own] = np.iinfo(np.int64).min
        assert best.scores[i].tolist() == sorted(scores[i], reverse=True)[:5]


def mined(rows, top, least=10):
    count, words = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in (1, 2, 3):
                count[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        found, often = [], [(p, a) for p, a in f.items() if a >= least]
        for phrase, a in often:
            if len(phrase) < 2:
                continue
            if len(phrase) == 2 and any(100 * b >= 50 * a for p, b in often if len(p) == 3 and phrase in (p[:2], p[1:])):
                continue
            score, k = min((10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, words[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases(odd_rows):
    rng = random.Random(22)
    small = ["new", "york", "City", "é", "of", "the", "a.b", "x\x1cy", "\x00"]
    texts = [" ".join(rng.choice(small) + rng.choice(["", "", "", ",", "\n", "\t", ".."]) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    rows = [(200 + i, t, rng.choice(["en", "en", "de", None, "und"]), "a") for i, t in enumerate(texts)]
    return odd_rows + rows


def test_collocations_equal_brute_force(make, phrases, nothing):
    got = sorted(tuple(r) for r in collocations.collocations(make(phrases)).drop("first_doc").collect())
    assert got == mined(phrases, 2000) and len(got) > 50
    few = sorted(tuple(r) for r in collocations.collocations(make(phrases), top=3).drop("first_doc").collect())
    assert few == mined(phrases, 3)
    assert collocations.collocations(nothing).count() == 0


def test_colliding_fingerprints_are_told_apart(make, phrases, monkeypatch):
    """With fingerprints of eight values and a filter that admits all, texts decide."""
    whole = collocations.Slice.fingerprints
    monkeypatch.setattr(collocations.Slice, "fingerprints", lambda self, n, at: whole(self, n, at) & np.uint64(7))
    texts = make(phrases).selectExpr("doc_id", "coalesce(lang, 'und') as lang", "coalesce(text, '') as text")
    full = collocations.Filter(np.full(collocations.FILTER_BITS // 8, 255, np.uint8))
    rows = collocations.read_back(texts, {1: full, 2: full, 3: full}).filter("times >= 10")
    sizes = collocations.counted(texts, (1,)).filter("mark is null").selectExpr("lang", "times as n")
    assert sizes.count() > 2
    found = collocations.best(collocations.uncovered(collocations.scored(rows), rows), 2000).join(sizes, "lang")
    assert sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == mined(phrases, 2000)


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**12
    rows = [("en", 1, "a", big + 7, 1), ("en", 1, "b", big + 9, 1), ("en", 2, "a b", big, 1)]
    df = spark.createDataFrame(rows, "lang string, words int, phrase string, times long, first_doc long")
    assert collocations.scored(df).first().score == 10**6 * big * big // ((big + 7) * (big + 9))
