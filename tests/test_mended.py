"""Forms that were once answered wrongly, against hand-computed or library results."""

import html as library_html
import tracemalloc
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan import api
from folioscan.functions import html, urls, vectors
from folioscan.operators import changes, chunking, evaluation, filters, fusion, monitoring, nearest
from folioscan.streaming import jobs


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


LINKS = ["a/b", "../" * 12 + "x", "./a/./b", "q/..", "q/../", "..", "../..", "q/././y", "a//b", "/a/../b/./c", "/x/..", "?q=1", "#f", "", "b?x=../y", "//h/p", "mailto:x@y"]


@pytest.mark.parametrize("base", ["https://h.example/a/b/c/d", "https://h.example/", "https://h.example/a/b/c/d/e/f/g/h/i/j/k/l/m"])
def test_links_resolve_as_the_standard_library_does(spark, base):
    got = column(spark, LINKS, lambda v: urls.resolve(F.lit(base), v))
    assert got == [urljoin(base, x) for x in LINKS]


def test_targets_in_any_quoting(spark):
    page = """<a href="/a?x=1&amp;y=2">1</a><A class=b HREF='/b'>2</A><a href=/c>3</a>"""
    assert column(spark, [page], html.hrefs) == [["/a?x=1&y=2", "/b", "/c"]]


def test_character_references(spark):
    texts = ["&copy;&#233;&#xE9; &amp;lt; &eacute;", "&nosuch; & &#0; &#xD800;", "x &lt;y&gt; &#128077;", ""]
    got = column(spark, texts, html.unescape)
    assert got[0] == library_html.unescape(texts[0]) and got[2] == library_html.unescape(texts[2]) and got[3] == ""
    assert got[1] == texts[1]


@pytest.mark.parametrize("text,private", [
    ("2001:db8::1", False), ("1::2::3", True), (":::1", True), ("12345::1", True), ("::1", True), ("fe80::1", True), ("fd00::1", True),
    ("1:2:3:4:5:6:7:8", False), ("1:2:3:4:5:6:7:8:9", True), ("2606:4700::", False), ("2606::1.2.3.4", False), ("2606::1.2.3", True), ("8.8.8.8", False), ("10.1.1.1", True), ("x", True),
])
def test_addresses(spark, text, private):
    assert column(spark, [text], urls.is_private_address) == [private]


def test_include_and_exclude_are_plain_text(spark):
    got = column(spark, ["https://h/v1.0/?a", "https://h/v1x0/a", "https://h/b"], lambda v: filters.follow_link(v, F.lit("h"), ["/v1.0/?a"], []))
    assert got == [True, False, False]


def test_equal_sections_are_no_change(spark):
    spec = "doc_id int, section_id string, content string, content_hash string, path string, heading string, start_pos int"
    rows = [(1, "s", "same start", "h1", "p", "h", 0), (1, "s", "same start, other end", "h2", "p", "h", 50)]
    same = spark.createDataFrame(rows, spec)
    assert [r.action for r in changes.section_changes(same, same, "doc_id").collect()] == ["unchanged"]


def test_overlap_is_checked():
    with pytest.raises(ValueError):
        chunking.size_windows(F.col("x"), overlap=10_000)


def test_decline_has_no_p_value_over_one(spark):
    one = spark.range(1).select(evaluation.heuristic_p_value(F.lit(2.0), F.lit(1.0)), evaluation.heuristic_p_value(F.lit(1.0), F.lit(4.0)))
    assert tuple(one.first()) == (0.5, 0.001)


def test_boost_changes_the_order(spark):
    lex = spark.createDataFrame([(1, 10, 1, 0.5), (1, 20, 2, 12.0)], "query_id int, doc_id int, rank int, score double")
    sem = spark.createDataFrame([(1, 30, 1), (1, 10, 3)], "query_id int, doc_id int, rank int")
    got = {r.doc_id: (r.rank, r.boosted) for r in fusion.boosted_fusion(lex, sem, 5).collect()}
    assert got[20] == (2, pytest.approx(2 / 61)) and got[10] == (1, pytest.approx(1.05 / 60 + 1 / 62)) and got[30] == (3, pytest.approx(1 / 60))


@pytest.mark.parametrize("parts", [1, 6])
def test_streams_read_folders_and_files_and_keep_the_tail(spark, tmp_path, parts):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    table = jobs.event_table(spark, str(tmp_path), "events")
    shape = lambda e: jobs.windows(e, ["event_type"], "1 hour", None, "2 hours")
    got = jobs.drain(shape(jobs.stream_table(spark, str(tmp_path), "events")), "t", jobs.tail(shape(table), table, "window_end", "2 hours"))
    assert got.agg(F.sum("n")).first()[0] == events.count()
    assert got.count() == shape(table).count()


def test_vector_tiles_bound_memory_and_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    unit = lambda n: nearest._unit_rows(np.round(rng.normal(size=(n, 4)), 1))
    q, c = unit(90), unit(70)
    ids = np.arange(70)
    whole = nearest._score_block(np.arange(90), q, ids, c, 5, 0.1)
    monkeypatch.setattr(nearest, "QUERY_TILE", 16)
    monkeypatch.setattr(nearest, "ROW_TILE", 7)
    tiled = nearest._score_block(np.arange(90), q, ids, c, 5, 0.1)
    order = ["query_id", "similarity", "chunk_id"]
    assert whole.sort_values(order).values.tolist() == tiled.sort_values(order).values.tolist()


def test_many_query_vectors_against_few_rows():
    """200,000 queries at once: the product of one tile is all that stands in memory."""
    q = nearest._unit_rows(np.random.default_rng(2).normal(size=(200_000, 16)))
    tracemalloc.start()
    found = nearest._score_block(np.arange(200_000), q, np.arange(30), q[:30], 1, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 200_000 and peak < 300e6


def test_embedding_models_are_registered_by_name(spark):
    vectors.register_embedder("lengths", lambda: lambda text: F.array(F.length(text).cast("double")))
    assert spark.range(1).select(vectors.embedder("lengths")(F.lit("abc"))).first()[0] == [3.0]


def test_alert_rules_see_absence_and_spikes(spark):
    rows = [(f"2024-01-01 00:{m:02d}:00", "error") for m in range(0, 20) for _ in range(2)] + [("2024-01-01 02:00:00", "page")]
    r = spark.createDataFrame(rows, "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    none = spark.createDataFrame([], "step timestamp, quantile double")
    got = {x.alert: x.firing for x in monitoring.firing(monitoring.alert_steps(r, none)).collect()}
    # errors: 20 in the ten minutes up to the steps 00:05, 00:10 and 00:15; the condition has held ten minutes at the last of them
    assert got["error_spike"] == 1 and got["no_traffic"] > 10 and got["stalled"] == 0 and got["p95_high"] == 0


def test_no_cap_on_results(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha w"), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, query_text string")
    assert api.Corpus(docs).search_fulltext(asked, 500).count() == 500
    assert api.Corpus(docs.withColumn("path", F.col("doc_id").cast("string"))).list_resources(limit=500).count() == 500
