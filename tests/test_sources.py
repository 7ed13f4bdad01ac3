import json

from pyspark.sql import functions as F

from folioscan.operators import lexical, validation
from folioscan.sources import readers, writers


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.md").write_text("---\nsource_url: 'https://x.org/a:b'\nkind: guide\n---\n# The Title\n\ntext")
    (tmp_path / "a" / "b" / "two.md").write_text("no heading here")
    (tmp_path / "a" / "skip.txt").write_text("# nope")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.markdown_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"one.md", "two.md"}
    assert got["one.md"].title == "The Title" and got["one.md"].front_matter == {"source_url": "https://x.org/a:b", "kind": "guide"}
    assert got["one.md"].body.strip() == "# The Title\n\ntext"
    assert got["two.md"].title == "two" and got["two.md"].front_matter == {}


def test_feeds_and_sitemaps(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><title>c</title><item><title>A &amp; B</title><link>https://x/1</link></item></channel></rss>")
    (tmp_path / "atom.xml").write_text('<feed><entry><title>T</title><link rel="alternate" href="https://x/2"/></entry></feed>')
    (tmp_path / "sitemap.xml").write_text("<urlset><url><loc> https://x/3 </loc></url><url><loc>https://x/4</loc></url></urlset>")
    assert {(r.title, r.link) for r in readers.feeds(spark, str(tmp_path), "{rss,atom}.xml").collect()} == {("A & B", "https://x/1"), ("T", "https://x/2")}
    assert {r.url for r in readers.sitemaps(spark, str(tmp_path)).collect()} == {"https://x/3", "https://x/4"}


def test_source_registry(spark, tmp_path):
    (tmp_path / "good.yaml").write_text("name: docs\nbase_urls: ['https://x.org/']\ndepth: 2\n")
    (tmp_path / "off.yml").write_text("name: 5\nbase_urls: []\nenabled: false\n")
    (tmp_path / "broken.yaml").write_text("a: [1\n")
    reg = readers.source_registry(spark, str(tmp_path))
    assert reg.filter("config is null").count() == 1
    on = readers.enabled_sources(reg.filter("config is not null"))
    assert on.count() == 1
    issues = validation.source_issues(reg.filter("config is not null"), "path", "config")
    assert {r.code for r in issues.collect()} == {"INVALID_FIELD_TYPE", "EMPTY_BASE_URLS", "UNKNOWN_FIELD"}


def test_json_inputs(spark, tmp_path):
    (tmp_path / "docs.json").write_text('{"doc_id":"a","title":"T","tags":["x"]}\n{"doc_id": broken\n')
    rows = readers.source_documents(spark, str(tmp_path / "docs.json")).cache()
    assert rows.filter("_corrupt_record is null").count() == 1 and rows.filter("_corrupt_record is not null").count() == 1
    gold = {"name": "g", "queries": [{"id": "q1", "query": "x", "relevant_docs": ["a", "b"], "domain": "t"}, {"id": "q2", "query": "y", "relevant_docs": [], "domain": "t"}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold, indent=2))
    assert {(r.query_id, r.doc_id) for r in readers.gold_set(spark, str(tmp_path / "gold.json")).collect()} == {("q1", "a"), ("q1", "b"), ("q2", None)}


def test_settings_merge():
    assert readers.merged_settings({"a": {"x": 1, "y": 2}, "b": [1]}, {"a": {"y": 3}, "b": [2], "c": None}) == {"a": {"x": 1, "y": 3}, "b": [2], "c": None}


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "Title: x", "body\ntext")], "doc_id long, source string, title string, body string")
    writers.write_markdown(docs, str(tmp_path / "md"), "source", "body", ["title"])
    back = spark.read.option("lineSep", "\u001e").text(str(tmp_path / "md")).first()
    assert back.value == '---\ntitle: "Title: x"\n---\n\nbody\ntext' and back.source == "s"
    post = lexical.postings(lexical.tokenised(docs, "doc_id", F.col("body")))
    writers.write_postings(post, str(tmp_path / "idx"))
    assert {(r.term, r.tf) for r in spark.read.parquet(str(tmp_path / "idx")).collect()} == {("body", 1), ("text", 1)}
    events = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id long, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    writers.append_events(events, str(tmp_path / "log"))
    writers.append_events(events, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).filter("day = '2024-01-02'").count() == 2
    q = spark.createDataFrame([("a", 0.5)], "mode string, f1 double")
    p = spark.createDataFrame([("a", 9.0), ("b", 1.0)], "mode string, ms double")
    flat = writers.flat_results(q, p, ["mode"])
    assert flat.columns == ["mode", "quality_f1", "perf_ms"] and flat.count() == 2
    writers.write_results(flat, str(tmp_path / "res"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "res")).count() == 2
