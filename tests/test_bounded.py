"""Score-bounded top-k against full scoring."""

import random

from pyspark.sql import functions as F

from folioscan.operators import lexical, term_scores


def test_bounded_search_equals_full_scoring(spark):
    """Frequent words in every query, ties from equal documents, words that no document holds, fewer hits than k."""
    rng = random.Random(1)
    rare = [f"rare{i}" for i in range(300)]
    texts = [" ".join(rng.choices(["the", "of", "and"], k=rng.randint(1, 30)) + rng.sample(rare, rng.randint(0, 5))) for _ in range(800)]
    texts += ["the of rare1 rare2"] * 12 + ["", None]
    docs = lexical.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", F.col("text"))
    asked = [" ".join(["the", "of", "and", *rng.sample(rare, 3)]) for _ in range(30)] + ["the of", "rare1 rare2", "unknown word", "the unknown", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    for k in (1, 10, 2000):
        rows, counts = lexical.bounded_top_k(queries, docs, k)
        got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in rows.collect())
        full = lexical.rank_top_k(lexical.bm25(queries, docs), k).collect()
        assert got == sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in full)
        c = counts.first()
        print(f"k {k}: {c.n_scored} of {c.n_postings} postings scored")
        assert k > 10 or c.n_scored < 0.5 * c.n_postings


def test_scoring_where_documents_lie_meets_no_postings(spark):
    """Equal to scores from joined postings, also for all terms; neither postings nor pairs are exchanged, and a task's best rows hold k per query."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "c", "d", "e", "f"], k=rng.randint(0, 12))) for _ in range(500)] + [None]
    docs = lexical.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3), "doc_id", F.col("text"))
    queries = spark.createDataFrame([("q1", "a b"), ("q2", "c zz"), ("q3", None), ("q4", "a b c d e f")], "query_id string, query_text string")
    cells = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "matched", "score").collect())
    got = lexical.top_k(queries, docs, 7)
    assert cells(got) == cells(lexical.rank_top_k(lexical.bm25(queries, docs), 7))
    assert cells(lexical.with_all_terms(queries, docs)) == cells(lexical.bm25(queries, docs, match="all"))
    asked = term_scores.gathered(lexical.query_terms(queries))
    rows = term_scores.term_rows(docs, asked)
    weights, _ = term_scores.bm25_weights(rows, asked, lexical.K1, lexical.B)
    sent = term_scores.scored(rows, asked, weights, 7, 6)
    assert sent.filter("doc_id is not null").count() <= 7 * 3 * rows.rdd.getNumPartitions()
    assert term_scores.gathered(lexical.query_terms(queries), 10) is None
