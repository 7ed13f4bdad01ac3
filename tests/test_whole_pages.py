"""Queries over pages take every page."""

import duckdb
from pyspark.sql import functions as F

from folioscan.operators import links
from folioscan.plans import load_all

SMALL = "/root/testdata/sf0.01"


def test_pages_of_any_scheme_are_converted(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert pages.filter(~F.col("url").startswith("https://")).count() > 0
    done = load_all()["page_to_markdown"].run(spark, SMALL)
    assert done.select("page_id").exceptAll(pages.select("page_id")).count() == 0
    assert pages.select("page_id").exceptAll(done.select("page_id")).count() == 0


def test_titles_meet_the_whole_text(spark):
    got = load_all()["trigram_similarity"].run(spark, SMALL).selectExpr("count(*) as n", "count_if(title_contained) as found").first()
    assert got.n == spark.read.parquet(f"{SMALL}/pages.parquet").count() and got.found > 0


def test_every_link_leads_on(spark):
    """Second links count, addresses without a page lead to their site's pages, and cycles end."""
    pages = spark.createDataFrame(
        [(1, "https://a.example/", '<a href="/x">x</a><a href="/two#part">2</a>'), (2, "https://a.example/two", '<a href="https://b.example/p?q=1">b</a>'),
         (3, "https://b.example/", '<a href="https://a.example/">a</a>')],
        "page_id long, url string, html string",
    )
    depths = {r.node: r.depth for r in links.reach(links.link_edges(pages), spark.createDataFrame([("p1",)], "node string"), 6).collect()}
    assert depths == {"p1": 0, "https://a.example/x": 1, "p2": 1, "https://a.example": 2, "https://b.example/p?q=1": 2, "https://b.example": 3, "p3": 4}


def test_short_pages_and_overlapping_blocks_become_markdown(spark, tmp_path):
    """Short Markdown stays Markdown; navigation goes before heads and footers, as in the SQL; a last line separator is no end."""
    rows = [
        (1, "https://a.example/x", "<body><h1>T</h1><p>a <b>b</b></p></body>"), (2, "https://a.example/", "<body><footer>a <head>b</footer> c</head><p>d</p></body>"),
        (3, "https://a.example/y", "<body><p>e</p>\u2028</body>"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    entry = load_all()["page_to_markdown"]
    got = sorted(tuple(r) for r in entry.run(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(entry.sql).fetchall())
    assert got[0][2] == "# T\n\na **b**"
