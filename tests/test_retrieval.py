import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.functions.vectors import cosine, embedder
from folioscan.operators import fusion, lexical, nearest


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, vector array<float>")


def test_known_vectors(spark):
    q = vectors(spark, [(0, [0.1, 0.2, 0.3])], "query_id")
    c = vectors(spark, [(1, [0.1, 0.2, 0.3]), (2, [0.4, 0.5, 0.6]), (3, [0.15, 0.25, 0.35]), (4, [0.0, 0.0, 0.0]), (5, None)], "chunk_id")
    got = nearest.top_k_similar(q, c, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in got] == [(1, 1), (3, 2)]
    assert got[0].similarity == pytest.approx(1.0)
    zero = nearest.top_k_similar(q, c, 10).filter("chunk_id = 4").first()
    assert zero.similarity == 0.0


def test_orthogonal_and_mismatch(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    with pytest.raises(Exception, match="dimensions differ"):
        df.select(cosine(F.col("a"), F.array(F.lit(1.0)))).collect()
    q, c = vectors(spark, [(0, [1.0, 0.0])], "query_id"), vectors(spark, [(1, [1.0, 0.0, 0.0])], "chunk_id")
    with pytest.raises(Exception, match="dimensions differ"):
        nearest.top_k_similar(q, c, 1).collect()


def test_scan_blocks_and_brute_force_agree(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(90, 8))
    base[30:60] = base[0]  # a third of all chunks are copies: ties are cut by id
    chunks = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    queries = [(100 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(11, 8)))] + [(99, chunks[0][1])]
    q, c = vectors(spark, queries, "query_id"), vectors(spark, chunks, "chunk_id")
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.similarity) for r in df.collect())
    scan = key(nearest.top_k_similar(q, c, 7, 0.1))
    grid = key(nearest.top_k_similar(q, c, 7, 0.1, query_limit_bytes=8 * 8 * 3))
    want = []
    f32 = lambda v: np.asarray(v, dtype=np.float32).astype(float)
    for i, v in queries:
        a = f32(v)
        s = [(-round(float(a @ f32(w) / np.linalg.norm(a) / np.linalg.norm(f32(w))), 6), j) for j, w in chunks]
        s = sorted(x for x in s if -x[0] >= 0.1)[:7]
        want += [(i, r + 1, j, -x + 0.0) for r, (x, j) in enumerate(s)]
    assert scan == grid == sorted(want)


def test_probe_scans_only_chosen_cells(spark):
    rng = np.random.default_rng(11)
    rows = [(i, i % 3 if i < 40 else 0, [float(x) for x in rng.normal(size=4)]) for i in range(120)]  # one hot cell
    chunks = spark.createDataFrame(rows, "chunk_id long, cell_id long, vector array<double>")
    cells = spark.createDataFrame([(j, [1.0 if i == j else 0.0 for i in range(4)]) for j in range(3)], "cell_id long, vector array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.2, 0.0, 0.0]), ("b", [0.0, 0.1, 1.0, 0.0])], "query_id string, vector array<double>")
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.similarity) for r in df.collect())
    scan = key(nearest.probe_centroids(q, chunks, cells, 5, 2))
    assert scan == key(nearest.probe_centroids(q, chunks, cells, 5, 2, query_limit_bytes=40))
    allowed = {"a": {0, 1}, "b": {2, 1}}
    cell_of = {i: c for i, c, _ in rows}
    assert all(cell_of[c] in allowed[n] for n, _, c, _ in scan) and len(scan) == 10
    exact = {n: [] for n in allowed}
    for n, v in (("a", [1.0, 0.2, 0.0, 0.0]), ("b", [0.0, 0.1, 1.0, 0.0])):
        a = np.array(v)
        s = sorted((-round(float(a @ np.array(w) / np.linalg.norm(a) / np.linalg.norm(w)), 6), i) for i, c, w in rows if c in allowed[n])
        exact[n] = [i for _, i in s[:5]]
    assert {n: [c for m, _, c, _ in scan if m == n] for n in allowed} == exact


def test_bm25_all_is_any_with_every_term(spark):
    docs = spark.createDataFrame(
        [(i, "the common words " + ("rare find" if i % 4 == 0 else "") + (" deep" if i % 6 == 0 else "")) for i in range(40)], "doc_id long, text string"
    )
    tokens = lexical.tokenised(docs, "doc_id", F.col("text"))
    q = spark.createDataFrame([(1, "the rare deep"), (2, "common missingterm"), (3, "words")], "query_id long, query_text string")
    every = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(q, tokens, "all").collect()}
    n = {1: 3, 2: 2, 3: 1}
    some = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(q, tokens).collect() if r.matched == n[r.query_id]}
    assert every == some and every
    assert not [k for k in every if k[0] == 2]


def test_blank_query_gives_nothing(spark):
    docs = lexical.tokenised(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "doc_id", F.col("text"))
    q = spark.createDataFrame([(1, "  ")], "query_id long, query_text string")
    assert lexical.bm25(q, docs).count() == 0


def test_rrf_adds_both_branches(spark):
    lex = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    sem = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    got = {r.doc_id: (r.rrf_score, r.rank) for r in fusion.reciprocal_rank_fusion(lex, sem, 10).collect()}
    assert got[11][0] == pytest.approx(1 / 61 + 1 / 62) and got[11][1] == 1
    assert got[10][1] == 2 and got[12][1] == 3


def test_diversify_keeps_three(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (1, 4, "a"), (1, 5, "b"), (1, 6, "b")]
    df = spark.createDataFrame(rows, "query_id long, rank int, section string")
    assert sorted(r["rank"] for r in fusion.diversify(df, "section").collect()) == [1, 2, 3, 5]


def test_embedder(spark):
    df = spark.createDataFrame([(1, "same text"), (2, "Same, text!"), (3, ""), (4, None)], "id long, t string")
    v = {r.id: np.array(r.v) for r in df.select("id", embedder("hashing-384")(F.col("t")).alias("v")).collect()}
    assert np.allclose(v[1], v[2]) and np.linalg.norm(v[1]) == pytest.approx(1.0)
    assert not v[3].any() and not v[4].any() and len(v[3]) == 384
    with pytest.raises(ValueError):
        embedder("unknown")


def test_weight_update_needs_ten_clicks(spark):
    def weights(n, position):
        rows = [(i, f"2024-01-01 00:00:{i:02d}", position) for i in range(n)]
        df = spark.createDataFrame(rows, "event_id long, ts string, position int").withColumn("ts", F.col("ts").cast("timestamp"))
        return fusion.updated_weights(df, F.lit("2024-01-01").cast("timestamp")).first()

    assert weights(9, 0).w_click_rate == 0.8
    good, poor = weights(10, 2), weights(10, 3)
    assert good.w_avg_dwell_time / good.w_rrf_score == pytest.approx(0.3 * 1.01 / 0.6)
    assert poor.w_click_rate / poor.w_rrf_score == pytest.approx(0.8 * 0.99 / 0.6)
    assert sum(v * v for k, v in good.asDict().items() if k.startswith("w_")) == pytest.approx(1.0)


def test_embedder_hashes_a_token_once_per_task(spark, monkeypatch):
    """Every token of every text used to be hashed; many copies of a word now cost one hash."""
    import hashlib

    import pyarrow as pa

    from folioscan.functions import vectors

    seen = []
    monkeypatch.setattr(vectors, "hashed_slot", lambda t, dims, real=vectors.hashed_slot: seen.append(t) or real(t, dims))
    known = {}
    rows = [["aa", "bb", "aa"] * 50, [], ["bb", "é"]]
    got = [vectors._embed_batch(pa.array(rows, pa.list_(pa.string())), 64, known).to_pylist() for _ in range(2)]
    assert sorted(seen) == ["aa", "bb", "é"] and got[0] == got[1] and got[0][1] == [0.0] * 64
    want = np.zeros(64)
    for t in rows[2]:
        h = hashlib.md5(t.encode()).hexdigest()
        want[int(h[:7], 16) % 64] += -1.0 if int(h[7], 16) % 2 else 1.0
    assert np.allclose(got[0][2], want / np.linalg.norm(want))


def test_texts_are_not_moved_to_meet_the_few_hits(spark):
    """Whole texts used to be shuffled by doc_id, and all clicks grouped, for ten hits per query."""
    from folioscan.plans import ranking_queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ranking_queries.features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [doc_id" in plan and "BroadcastHashJoin [chunk_id" in plan
