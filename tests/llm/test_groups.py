"""Operators that relate documents to one another: copies, near copies, classifiers, the mix, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sample_texts import prose

from folioscan.llm import exact_dedup, fuse, mixing, near_dedup, preference, quality_rules, textstats
from folioscan.llm.components import components

BLANKS = r"[\x20\x09-\x0D]+"


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 30_000])
def test_fuse_filter_holds_all_and_admits_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    f = fuse.build(keys)
    assert f.contains(keys).all()
    others = rng.integers(0, 2**63, 50_000, dtype=np.int64).astype(np.uint64)
    assert f.contains(others).mean() < 0.01


def copies(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256(re.sub(BLANKS, " ", t or "").encode()).hexdigest()].append(i)
    want = []
    for mark, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, mark) for i in ids]
    return want


@pytest.mark.parametrize("old", ["doc_id < 7", "doc_id % 2 = 0", "true", "false"])
def test_exact_copies_of_odd_rows(odd, odd_rows, old):
    got = [tuple(r) for r in exact_dedup.exact_dedup(odd, F.expr(old)).collect()]
    assert sorted(got, key=str) == sorted(copies(odd_rows), key=str)


def test_without_copies(odd, nothing):
    left = exact_dedup.without_copies(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [0, 2, 3, 5, 7, 8, 9, 10, 12]
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_different_texts_of_one_digest_are_told_apart(make, monkeypatch):
    """With a digest that sees the length only, bytes decide."""
    monkeypatch.setattr(exact_dedup, "digest_of", lambda text: F.unhex(F.sha2(F.length(exact_dedup.normalised(text)).cast("string"), 256)))
    rows = [(1, "aa", None, None), (2, "bb", None, None), (3, "aa", None, None), (4, "ccc", None, None), (5, "bb", None, None)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(make(rows)).collect()}
    assert got == {(1, 1, 2, True), (3, 1, 2, False), (2, 2, 2, True), (5, 2, 2, False), (4, 4, 1, True)}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, len(sets[i]), least.get(root(i)), d == least.get(root(i))) for i, (d, *_) in enumerate(rows)], key=str)


def test_near_copies_of_odd_rows(odd, odd_rows, nothing):
    got = sorted([tuple(r) for r in near_dedup.near_dedup(odd).collect()], key=str)
    assert got == near(odd_rows)
    assert near_dedup.near_dedup(nothing).count() == 0


def varied(rng, words, share):
    out = list(words)
    for _ in range(int(len(words) * share)):
        out[rng.randrange(len(out))] = "".join(rng.choice("abcdefgh") for _ in range(6))
    return " ".join(out)


@pytest.fixture(scope="module")
def crowd():
    """A large family of near copies on both sides of the threshold, a shared passage, and small families."""
    rng = random.Random(9)
    base, passage = prose(rng, 150).split(), prose(rng, 60)
    rows = [(i, varied(rng, base, rng.choice([0.005, 0.01, 0.03, 0.05, 0.08])), None, "a") for i in range(260)]
    rows += [(1000 + i, passage + " " + prose(rng, rng.choice([20, 90])), None, "b") for i in range(60)]
    for k in range(25):
        own = prose(rng, rng.choice([6, 30, 200])).split()
        rows += [(2000 + 10 * k + i, varied(rng, own, rng.choice([0, 0.02, 0.04])), None, "c") for i in range(rng.randint(2, 5))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [192, 24])
def test_crowds_lose_no_component(make, crowd, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = sorted([tuple(r) for r in near_dedup.near_dedup(make(crowd)).collect()], key=str)
    assert got == near(crowd)


def test_signatures_estimate_similarity():
    rng = random.Random(10)
    words = prose(rng, 400).split()
    a, b = (near_dedup.shingles(" ".join(x).encode()) for x in (words, words[:330] + ["x"] * 40))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - true) < 0.15


def test_components(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def test_components_write_few_files_for_few_links(spark, monkeypatch):
    """However many shuffle partitions there are: on a local disk each file costs processes of the executor."""
    from folioscan.llm import components as module

    written = []

    def saved(df, label):
        kept = module_saved(df, label)
        written.append((label, len(kept.inputFiles())))
        return kept

    module_saved = module.saved
    monkeypatch.setattr(module, "saved", saved)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        chain = [(i, i + 1) for i in range(0, 600) if i % 3 < 2]
        got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 3 for i in range(600)}
    rounds = [n for label, n in written if label == "roots"]
    assert len(rounds) > 1 and max(rounds) <= spark.sparkContext.defaultParallelism


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    repeated = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_rule_counts_equal_brute_force(odd_rows):
    rng = random.Random(12)
    texts = [t or "" for _, t, *_ in odd_rows] + ["".join(rng.choice(["a ", "b ", "c\n", "\n", "é ", "|", "#", "\x1c", "\x85", " ", "a b c "]) for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert textstats.counts(t.encode())[:5] == rule_counts(t)
    ids = np.array([rng.randrange(5) for _ in range(400)])
    assert textstats.repeated(ids, 5) == textstats.repeated(ids, 2_000_000)


@pytest.fixture(scope="module")
def judged_rows(make, spark):
    rng = random.Random(13)
    rows, marks = [], []
    for i in range(500):
        words = prose(rng, rng.randint(60, 200)).split()
        bad = i % 7 == 0
        if bad:
            words = [w + rng.choice(["###", "$$$", "!!"]) for w in words] if i % 2 else [words[0]] * 40 + words[:30]
        rows.append((i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)), None, "a"))
        if i % 2 or bad:
            marks.append((i, 0 if bad else 1, 0))
    return make(rows), spark.createDataFrame([*marks, (None, 1, 0), (marks[0][0], marks[0][1], 0), (7, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_rules(judged_rows, odd, odd_rows, nothing):
    docs, labels = judged_rows
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    good = [r for i, r in found.items() if i % 7]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert not any(r.kept for i, r in found.items() if i % 7 == 0)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found.values())
    assert quality_rules.quality_rules(odd, labels).count() == len(odd_rows)
    assert quality_rules.quality_rules(odd, labels.limit(0)).filter("kept and base_failed").count() == 0
    assert quality_rules.quality_rules(nothing, labels).count() == 0


def test_preference_ranking_on_held_out_rows(judged_rows, odd, odd_rows, nothing):
    docs, labels = judged_rows
    found = {r.doc_id: r for r in preference.ranked(docs, labels).collect()}
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    tested = [(r.predicted, 0 if i % 7 == 0 else 1) for i, r in found.items() if r.held_out]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested)
    assert preference.ranked(odd, labels).count() == len(odd_rows)
    assert {r.score for r in preference.ranked(odd, labels.limit(0)).collect()} == {0.5}
    assert preference.ranked(nothing, labels).count() == 0


def targets(sizes):
    """Water-filling by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
        if not open_:
            return out


def test_mix(make, odd, nothing):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randint(0, 60)), None, rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(600)]
    found = mixing.mixture(make(rows)).collect()
    assert found and sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mixture(make(rows)).collect()), key=str)
    source = {i: s for i, _, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.size == len(rows[r.doc_id][1].split()) and r.taken in (0, r.size, 2 * r.size)
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = targets(sizes)
    for r in found:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]], abs=1e-4)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    times = mixing.mixed_documents(make(rows)).groupBy("doc_id").count()
    got = {r.doc_id: r["count"] for r in times.collect()}
    assert all(got.get(r.doc_id, 0) * r.size == r.taken for r in found)
    assert mixing.mixture(odd).count() == odd.count() and mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixture(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_pipeline(spark, tmp_path, make, odd_rows):
    import corpus_pipeline

    rng = random.Random(15)
    rows = [(100 + i, prose(rng, 60, ("de", "en", "es", "fr")[i % 4]), ("de", "en", "es", "fr")[i % 4], "abc"[i % 3]) for i in range(40)]
    make(odd_rows + rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "exact dedup":
            held = [(r.doc_id, r.text) for r in docs.collect()]
            assert len(held) == len({re.sub(BLANKS, " ", t) for _, t in held})
        if name == "MinHash near-dedup":
            assert ids and set(ids) == {d for d, _, low, kept in near([(r.doc_id, r.text) for r in before.collect()]) if kept}
        if name == "source mix":
            assert all(ids.count(i) <= 2 for i in ids)
    assert set(range(100, 140)) - set(ids) == set(range(100, 140)) - {r.doc_id for r in before.collect()}
    for r in docs.collect():
        assert r.n_tokens == len(r.ids)
    texts = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in before.collect()}
    assert all(r.decoded_sha256 == texts[r.doc_id] for r in docs.collect())


def test_rows_without_a_partner_in_linked():
    assert near_dedup.linked(pd.DataFrame({"doc_id": [1], "text": ["a b"], "side": [0], "root": [None]})).empty
