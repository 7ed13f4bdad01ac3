"""Operators against brute force on small inputs in which one key holds a third of the rows or more."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscan.operators import aggregates, caching, changes, evaluation, links, monitoring, ranks, similarity


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 2 else f"k{i % 7}", i * 600, round(rng.expovariate(0.2), 2)) for i in range(700)]
    df = spark.createDataFrame(rows, "event_id long, key string, s long, value double")
    return rows, df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))


def by_key(rows):
    out = {}
    for i, k, s, v in rows:
        out.setdefault(k, []).append((s, i, v))
    return {k: sorted(v) for k, v in out.items()}


def test_order_statistics(skewed):
    rows, df = skewed
    targets = {"lo": F.lit(0), "mid": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * 0.95), "hi": F.col("n") - 1}
    got = {r.key: (r.lo, r.mid, r.p95, r.hi) for r in ranks.order_statistics(df, ["key"], "value", targets).collect()}
    for k, seq in by_key(rows).items():
        v = sorted(x for _, _, x in seq)
        n = len(v)
        assert got[k] == (v[0], v[n // 2], v[int(n * 0.95)], v[-1])
    v = sorted(r[3] for r in rows)
    whole = ranks.order_statistics(df, [], "value", {"mid": F.floor(F.col("n") / 2)}).first()
    assert whole.mid == v[len(v) // 2]
    same = df.withColumn("value", F.lit(1.5))
    assert {r.mid for r in ranks.order_statistics(same, ["key"], "value", {"mid": F.floor(F.col("n") / 2)}).collect()} == {1.5}


def test_moving_average_and_previous_value(skewed):
    rows, df = skewed
    ema = ranks.moving_average(df, ["key"], "value", F.date_trunc("day", "ts"), [F.desc("ts"), F.desc("event_id")])
    got = {r.key: r.ema for r in ema.collect()}
    prev = ranks.previous_value(df, ["key"], "value", ["ts", "event_id"], F.date_trunc("day", "ts"), "p")
    before = {r.event_id: r.p for r in prev.collect()}
    assert len(before) == len(rows)
    for k, seq in by_key(rows).items():
        e = None
        for n, (_, i, v) in enumerate(seq):
            e = v if e is None else 0.1 * v + 0.9 * e
            assert before[i] == (seq[n - 1][2] if n else None)
        assert got[k] == pytest.approx(e)


def test_global_position(spark, skewed):
    rows, df = skewed
    got = {r.event_id: r.pos for r in ranks.global_position(df, ["value", "event_id"], "pos").collect()}
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((v, i) for i, _, _, v in rows))}
    assert got == want


def test_newest_and_endpoint_stats(spark, skewed):
    rows, df = skewed
    r = df.select("event_id", "ts", F.col("key").alias("endpoint"), F.lit(200).alias("status_code"), F.col("value").alias("response_time"))
    got = {x.endpoint: x for x in monitoring.endpoint_stats(r, history=100, least=20).collect()}
    for k, seq in by_key(rows).items():
        v = [x for _, _, x in seq][-100:]
        p95 = sorted(v)[int(len(v) * 0.95)] if len(v) > 20 else sum(v) / len(v)
        assert got[k].p95_response_time == pytest.approx(p95, abs=1e-6)
        assert got[k].total_requests == len(seq)


@pytest.mark.parametrize("n", [1, 20, 21])
def test_p95_sample_sizes(spark, n):
    r = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit("e").alias("endpoint"),
        F.lit(200).alias("status_code"), F.col("id").cast("double").alias("response_time"),
    )
    assert monitoring.endpoint_stats(r).first().p95_response_time == (19.0 if n == 21 else (n - 1) / 2)


def test_similarity_join_with_copies(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    texts = ["same text in many copies of a page"] * 40
    texts += [" ".join(rng.sample(vocab, 20)) for _ in range(30)]
    texts += [" ".join(t.split()[:-1] + ["other"]) for t in texts[40:55]] + ["", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = similarity.distinct_sets(df, "doc_id", "text")
    for threshold in (0.6, 0.9):
        got = {(r.a, r.b) for r in similarity.similar_sets(sets, sets, threshold).filter("a < b").collect()}
        reps = {}
        for i, t in enumerate(texts):
            reps.setdefault(frozenset(t.lower().split()), i)
        items = [(i, s) for s, i in reps.items() if s]
        want = {
            (min(i, j), max(i, j)) for x, (i, s) in enumerate(items) for j, u in items[x + 1:] if len(s & u) / len(s | u) > threshold
        }
        assert got == want
    half = F.col("doc_id") < 45
    got = {r.doc_id: r.reuse_from for r in similarity.reuse_candidates(df.filter(~half), df.filter(half), "doc_id", "text", 0.9).collect()}
    wset = [frozenset(t.lower().split()) for t in texts]
    want = {}
    for i in range(45, len(texts)):
        near = [j for j in range(45) if wset[i] and wset[j] and len(wset[i] & wset[j]) / len(wset[i] | wset[j]) > 0.9]
        if near:
            want[i] = min(near)
    assert got == want


def test_reach_with_cycle_and_hub(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")] + [("b", f"leaf{i}") for i in range(50)]
    e = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = {r.node: r.depth for r in links.reach(e, seeds, 3).collect()}
    assert got["a"] == 0 and got["b"] == 1 and got["c"] == got["leaf7"] == 2 and got["d"] == 3 and "e" not in got
    assert len(got) == 54


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, text string, version int")
    new = spark.createDataFrame([(2, "B", 2), (3, "c", 2), (3, "C", 3)], "doc_id long, text string, version int")
    assert {tuple(r) for r in changes.upsert(old, new, "doc_id", "version").collect()} == {(1, "a", 1), (2, "B", 2), (3, "C", 3)}
    kept, removed = changes.delete_where_in(old, new, "doc_id")
    assert [r.doc_id for r in kept.collect()] == [1] and removed.first().removed == 1


def test_section_decisions(spark):
    rows = [(1, "x", "modified", "p", "h", "abcdefghij" * 3, "abcdefghij" * 3 + "k"), (1, "y", "modified", "p", "h", "abcdef", "uvwxyz"),
            (1, "z", "added", "p", "h", None, "n"), (1, "w", "unchanged", "p", "h", "s", "s"), (1, "v", "deleted", "p", None, "o", None)]
    df = spark.createDataFrame(rows, "doc_id long, section_id string, action string, path string, heading string, old_content string, new_content string")
    plan = changes.reprocess_plan(df)
    assert {r.section_id: r.reprocess for r in plan.collect()} == {"x": False, "y": True, "z": True, "w": False, "v": True}
    s = changes.diff_stats(plan, ["doc_id"]).first()
    assert (s.added, s.modified, s.deleted, s.unchanged, s.reprocess_pct) == (1, 2, 1, 1, 75.0)


def test_cache(spark):
    moment = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    rows = [(k, i, f"2024-01-01 0{i}:00:00", f"2024-01-01 1{i}:00:00") for i, k in enumerate(["k1", "k2", "k3", "k4", "k1"])]
    puts = spark.createDataFrame(rows, "cache_key string, event_id long, a string, e string").select(
        "cache_key", "event_id", F.col("a").cast("timestamp_ntz").alias("accessed_at"), F.col("e").cast("timestamp_ntz").alias("expires_at")
    )
    entries = caching.put(puts)
    assert entries.count() == 4
    assert {r.cache_key for r in caching.evict(entries, 3).collect()} == {"k1", "k3", "k4"}
    assert caching.live(entries, F.lit("2024-01-01 12:30:00").cast("timestamp_ntz")).count() == 2
    asked = spark.createDataFrame([("k2",), ("nope",)], "cache_key string").withColumn("at", moment)
    assert {r.cache_key: r.hit for r in caching.lookup(asked, entries, "at").collect()} == {"k2": True, "nope": False}


def test_lru_replay(spark):
    rng = random.Random(1)
    log = [("s" if i % 3 else "t", f"k{rng.randrange(6)}", i, i) for i in range(300)]
    df = spark.createDataFrame(log, "shard string, cache_key string, ts long, event_id long")
    got = {r.shard: (r.hits, r.misses) for r in caching.replay(df, "shard", 3).collect()}
    for shard in "st":
        order, hits, n = [], 0, 0
        for s, k, *_ in log:
            if s == shard:
                n += 1
                hits += k in order
                order = [x for x in order if x != k] + [k]
                order = order[-3:]
        assert got[shard] == (hits, n - hits)


def test_histogram(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (3.0,), (99.0,)], "v double")
    got = {r.le: r.n for r in aggregates.cumulative_buckets(df, [], "v", [1.0, 5.0]).collect()}
    assert got == {"1": 2, "5": 3, "+Inf": 4}


def test_recrawl_and_change_reasons(spark):
    moment = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    stored = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 12:00:00"), (3, None)], "page_id long, t string")
    stored = stored.select("page_id", F.col("t").cast("timestamp_ntz").alias("last_crawled"))
    due = changes.recrawl_needed(spark.range(1, 5).select(F.col("id").alias("page_id")), stored, moment, 24)
    assert {r.page_id: r.due for r in due.collect()} == {1: True, 2: False, 3: False, 4: True}


def test_hash_split_is_stable(spark):
    df = spark.range(1000).withColumn("k", F.col("id").cast("string"))
    a = {r.k: r.part for r in aggregates.hash_split(df, "k", 0.8, 1).collect()}
    b = {r.k: r.part for r in aggregates.hash_split(df.repartition(7), "k", 0.8, 1).collect()}
    assert a == b and 700 < Counter(a.values())["train"] < 900


def test_relative_improvement(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0), (2.0, 3.0)], "b double, n double")
    got = [r[0] for r in df.select(evaluation.relative_improvement(F.col("b"), F.col("n"))).collect()]
    assert got == [float("inf"), 0.0, 50.0]
