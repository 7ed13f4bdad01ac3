import json

import pytest
from pyspark.sql import functions as F

from folioscan.operators import filters, policy, validation


def test_licenses_and_directives(spark):
    rows = [
        (1, "This is under the MIT License."), (2, "GNU General Public License\nVersion 3"), (3, "GNU General Public License, version 3"),
        (4, "Licensed under the Apache License, Version 2.0"), (5, "Creative Commons Attribution-ShareAlike 4.0"), (6, "nothing"),
        (7, "<META name='robots' content='noai, noimageai'>"), (8, "<!--  NOAI -->"), (9, "permission is hereby granted ... MIT"),
    ]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: (r.l, r.n) for r in df.select("id", policy.detect_license(F.col("t")).alias("l"), policy.has_noai(F.col("t")).alias("n")).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["MIT", None, "GPL-3.0", "Apache-2.0", "CC-BY-SA-4.0", None, None, None, "MIT"]
    assert [i for i in got if got[i][1]] == [7, 8]


@pytest.mark.parametrize(
    "url, reason",
    [
        ("https://example.org/a", None), ("http://10.1.2.3/", "private_address"), ("http://[fe80::1]/", "private_address"),
        ("http://localhost:8000/", "localhost"), ("file:///etc/passwd", "scheme"), ("https://example.org:22/", "port"),
        ("http://169.254.169.254/latest", "private_address"), ("http://metadata.google.internal/x", "metadata_host"), ("http:///x", "no_host"),
        ("http://user:pw@192.168.0.1/", "private_address"), ("https://8.8.8.8/", None), ("gopher://x/", "scheme"),
    ],
)
def test_fetch_safety(spark, url, reason):
    df = spark.createDataFrame([(url,)], "u string")
    assert policy.fetch_safety(df, "u").first().reason == reason


def test_resolved_addresses(spark):
    df = spark.createDataFrame([("https://a.org/", ["8.8.8.8"]), ("https://b.org/", ["8.8.8.8", "10.0.0.1"])], "u string, ips array<string>")
    assert [r.reason for r in policy.fetch_safety(df, "u", "ips").orderBy("u").collect()] == [None, "resolves_private"]


def test_robots(spark):
    body = "User-agent: a\nUser-agent: folioscan\nDisallow: /x/\nAllow: /\n\nUser-agent: *\nDisallow: /\nCrawl-delay: 7\n"
    robots = spark.createDataFrame([("h.org", 200, body), ("n.org", 404, body), ("o.org", 200, "Disallow: /\n")], "host string, status int, body string")
    pages = spark.createDataFrame([("https://h.org/x/1",), ("https://h.org/y",), ("https://n.org/x/1",), ("https://o.org/",), ("https://new.org/",)], "url string")
    ours = {r.url: r.robots_allowed for r in policy.can_fetch(pages, policy.robots_rules(robots, "folioscan/1.0")).collect()}
    assert ours == {"https://h.org/x/1": False, "https://h.org/y": True, "https://n.org/x/1": True, "https://o.org/": True, "https://new.org/": True}
    other = policy.can_fetch(pages, policy.robots_rules(robots, "someone")).filter("url = 'https://h.org/y'").first()
    assert other.robots_allowed is False and other.crawl_delay == 7.0


def test_strict_mode_blocks(spark):
    df = spark.createDataFrame([(1, "MIT License", True), (2, "BSD 3-Clause", True), (3, "BSD 3-Clause", False), (4, "<!-- noai -->", True)], "id long, t string, strict boolean")
    v = policy.content_verdict(df.withColumn("licenses", F.array(F.lit("MIT"))).withColumn("respect_noai", F.lit(True)), "t")
    got = {r.id: (r.compliant, [(x.type, x.severity) for x in r.violations]) for r in v.collect()}
    assert got[1] == (True, []) and got[2] == (False, [("license_incompatible", "error")])
    assert got[3] == (True, [("license_incompatible", "warning")]) and got[4] == (False, [("noai_directive", "error")])


def test_glob_rules(spark):
    df = spark.createDataFrame([("https://h.org/docs/a",), ("https://h.org/docs/private/b",), ("https://other.org/docs/a",), ("https://h.org/blog",)], "u string")
    rule = lambda allow, deny: [r[0] for r in df.select(filters.within_rules(F.col("u"), "https://h.org", allow, deny)).collect()]
    assert rule(["/docs/**"], ["*/private/*"]) == [True, False, False, False]
    assert rule([], []) == [True, True, False, True]


def codes(spark, config):
    text = config if isinstance(config, str) else json.dumps(config)
    df = spark.createDataFrame([(1, text)], "id long, c string")
    return {r.code: r.n for r in validation.source_issues(df, "id", "c").collect()}


def test_source_configurations(spark):
    good = {"name": "docs", "base_urls": ["https://example.org/"], "rate_limit": 1.5, "depth": 2, "priority": 5}
    assert codes(spark, good) == {}
    assert codes(spark, {}) == {"MISSING_REQUIRED_FIELD": 2}
    assert codes(spark, {**good, "depth": "2", "colour": 1}) == {"INVALID_FIELD_TYPE": 1, "UNKNOWN_FIELD": 1}
    assert codes(spark, {**good, "timeout": 5}) == {"UNKNOWN_FIELD": 1}
    assert codes(spark, {**good, "schema_version": "1.1", "timeout": 301}) == {"LONG_TIMEOUT": 1}
    assert codes(spark, {**good, "auth": {"type": "basic", "username": "u", "password": "p"}}) == {"PLAINTEXT_PASSWORD": 1}
    assert codes(spark, {**good, "include": ["a", "b"], "exclude": ["b", "a"]}) == {"CONFLICTING_PATTERNS": 2}
    assert codes(spark, {**good, "base_urls": ["http://example.org"], "depth": 3, "rate_limit": 0.01}) == {"INSECURE_URL": 1, "LONG_CRAWL_TIME": 1}


def test_source_documents(spark):
    shape = "doc_id string, title string, url string, content string, tags array<string>, categories array<string>, file_size long"
    df = spark.createDataFrame([("ok-1", "T", None, "c", [], [], None), ("", "x" * 501, "ftp://x", "", ["a b"], ["c"] * 21, -1)], shape)
    got = [set(r[0]) for r in df.select(validation.document_errors(F.lit("web"))).collect()]
    assert got[0] == set()
    assert got[1] == {"doc_id_empty", "title_long", "url_format", "content_empty", "tag_characters", "categories_many", "file_size_negative"}
