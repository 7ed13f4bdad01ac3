import math

import pytest

from folioscan.operators import evaluation as E


def test_conventions(spark):
    # q1: hits at 1 and 3 of three; q2 retrieves nothing; q3 has nothing relevant; q4 failed
    results = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (3, 1, 10), (4, 1, 10)], "query_id long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 10), (1, 12), (2, 20), (4, 10)], "query_id long, doc_id long")
    queries = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "query_id long, success boolean")
    m = {r.query_id: r for r in E.per_query(results, qrels, queries, [2, 5]).collect()}
    assert set(m) == {1, 2, 3}
    assert m[1].p5 == pytest.approx(2 / 3) and m[1].p2 == 0.5  # divided by the number retrieved
    assert m[1].r5 == 1.0 and m[1].ap == pytest.approx((1 + 2 / 3) / 2)
    assert m[1].ndcg5 == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert (m[2].p5, m[2].r5, m[2].ap, m[2].ndcg5, m[2].rr) == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert (m[3].p5, m[3].r5, m[3].ap, m[3].ndcg5) == (0.0, 1.0, 1.0, 1.0)
    s = E.summary(E.per_query(results, qrels, queries, [5]), [5]).first()
    p, r = (2 / 3) / 3, 2 / 3
    assert s.f1_at_5 == pytest.approx(2 * p * r / (p + r), abs=1e-6)


def test_modes_without_hits_count(spark):
    results = spark.createDataFrame([("a", 1, 1, 10)], "mode string, query_id long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 10)], "query_id long, doc_id long")
    queries = spark.createDataFrame([(1, True)], "query_id long, success boolean")
    s = {r["mode"]: r.precision_at_1 for r in E.summary(E.per_query(results, qrels, queries, [1], ["a", "b"]), [1], ["mode"]).collect()}
    assert s == {"a": 1.0, "b": 0.0}


def test_consistency_matches_all_pairs(spark):
    runs = {("q", r): {r % 3, 7} if r < 12 else {r} for r in range(18)}
    rows = [(q if r % 2 else " Q ", r, doc, True) for (q, r), docs in runs.items() for doc in docs]
    spec = "query string, run int, doc_id int, success boolean"
    other = [("once", 1, 5, True), ("q", 99, 5, False), ("twice", 1, 1, True), ("twice", 2, 2, True)]
    assert E.consistency(spark.createDataFrame(rows, spec)).first().consistency == 1.0  # one query only
    got = E.consistency(spark.createDataFrame(rows + other, spec)).first().consistency
    sets = list(runs.values())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    want = sum(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in pairs) / len(pairs)
    assert got == pytest.approx((want + 0) / 2)


def test_coherence_of_single_score(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.1), (2, 0.9)], "query_id long, score double")
    assert E.coherence(df).first()[0] == pytest.approx((0 + min(4 * 0.32, 1)) / 2)


def test_alerts(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0, 0.9), ("b", 900.0, 0.5, 0.1)], "mode string, avg_ms double, success_rate double, f1 double")
    got = {(r["mode"], r.type, r.severity) for r in E.alerts(df, 500, 0.95, 0.7).collect()}
    assert got == {("b", "performance", "medium"), ("b", "reliability", "high"), ("b", "quality", "medium")}
