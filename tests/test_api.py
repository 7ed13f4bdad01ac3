import pytest
from pyspark.sql import functions as F

from folioscan import api
from folioscan.functions import ids
from folioscan.operators import fusion


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "a/1", "spark shuffle tuning guide", "docs", "en"), (2, "a/2", "cooking pasta at home", "blog", "en"),
            (3, "a/3", "tuning a piano", "blog", "en"), (4, "a/4", "spark shuffle internals", "docs", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string, source string, lang string")
    clicks = spark.createDataFrame([(4, "2024-01-02 00:00:00", 9.0)] * 50, "chunk_id long, t string, dwell_time double")
    return api.Corpus(docs, clicks=clicks.withColumn("ts", F.col("t").cast("timestamp_ntz")))


def test_searches(spark, corpus):
    q = spark.createDataFrame([(1, "spark shuffle tuning"), (2, "  ")], "query_id long, query_text string")
    order = lambda df: [(r.query_id, r.doc_id) for r in df.orderBy("query_id", "rank").collect()]
    assert order(corpus.search_fulltext(q, 2)) == [(1, 1), (1, 4)]
    assert order(corpus.search_fulltext(q, 5, match="all")) == [(1, 1)]
    assert order(corpus.search_fulltext(q, 5, where={"lang": "de"})) == [(1, 4)]
    assert order(corpus.search_semantic(q, 1)) == [(1, 1)]
    assert order(corpus.search_hybrid(q, 2)) == [(1, 1), (1, 4)]
    since = F.lit("2024-01-01").cast("timestamp_ntz")
    assert order(corpus.search_hybrid(q, 1, since=since)) == [(1, 4)]  # clicks lift the other document


def test_lookup_and_paging(corpus):
    assert corpus.get_document(3).first().text == "tuning a piano"
    page = corpus.list_resources("a/1", 2).collect()
    assert [r.path for r in page] == ["a/2", "a/3"] and page[0].next_cursor == "a/3"
    assert corpus.list_resources("a/3", 2).first().next_cursor is None
    assert {r.source: r.documents for r in corpus.list_sources().collect()} == {"docs": 2, "blog": 2}


def test_jobs(spark):
    rows = [("j1", 1, 1, "queued"), ("j1", 2, 2, "running"), ("j1", 3, 3, "done"), ("j2", 5, 4, "queued")]
    ev = spark.createDataFrame(rows, "job_id string, ts long, event_id long, status string")
    assert [(r.job_id, r.status) for r in api.list_jobs(ev).collect()] == [("j2", "queued"), ("j1", "done")]
    assert [r.job_id for r in api.list_jobs(ev, "done").collect()] == ["j1"]


def test_sql_functions_and_pair_rerank(spark):
    ids.register_sql_functions(spark)
    df = spark.createDataFrame([(1, "q", 1, "short"), (1, "q", 2, "a longer text")], "query_id long, query_text string, rank int, text string")
    same = df.select(F.expr("generate_lineage_id('c', 'm', 'v')").alias("a"), ids.run_lineage_id(F.lit("c"), F.lit("m"), F.lit("v")).alias("b")).first()
    assert same.a == same.b
    by_length = fusion.pair_rerank(df, lambda q, t: F.length(t)).filter("new_rank = 1").first()
    assert by_length.text == "a longer text"
    assert fusion.pair_rerank(df).filter("new_rank = 1").first().text == "short"
