"""Link extraction and depth-wise traversal of a link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import html, urls
from folioscan.session import cut_lineage


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link, pos): resolved links without fragment, first occurrence of each per page."""
    raw = pages.select("page_id", "url", F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href"))
    resolved = raw.select("page_id", "url", "pos", urls.drop_fragment(urls.resolve(F.col("url"), F.col("href"))).alias("link"))
    return resolved.groupBy("page_id", "url", "link").agg(F.min("pos").alias("pos"))


def page_node(page_id: str) -> Column:
    return F.concat(F.lit("p"), F.col(page_id).cast("string"))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of a crawl graph over pages(page_id, url, html).

    A page leads to all its resolved links: to the page of that address (fragments aside; of several the one with the
    smallest page_id) or to the address itself. Such an address leads to its site, and a site to its pages, so a site of
    any number of pages takes as many edges as it has addresses.
    """
    found = page_links(pages).select("page_id", "link")
    known = pages.groupBy(urls.drop_fragment(F.col("url")).alias("link")).agg(F.min("page_id").alias("_target"))
    placed = found.join(known, "link", "left")
    target = F.coalesce(page_node("_target"), F.col("link"))
    outside = placed.filter("_target is null").select("link").distinct()
    return (
        placed.select(page_node("page_id").alias("src"), target.alias("dst"))
        .unionByName(outside.select(F.col("link").alias("src"), urls.site(F.col("link")).alias("dst")))
        .unionByName(pages.select(urls.site(F.col("url")).alias("src"), page_node("page_id").alias("dst")))
    )


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Breadth-first levels: (node, depth) with the smallest depth up to max_depth.

    edges(src, dst), seeds(node). Each level joins only the frontier, drops visited nodes by an anti join
    and is kept in the shared checkpoint folder, so the plan stays short and survives lost executors.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())  # every level reads them
    visited = cut_lineage(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi")
        found = step.select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti")
        frontier = cut_lineage(found.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def crawl_summary(results: DataFrame) -> DataFrame:
    """One row of crawl counters over results(status, retries, redirected, policy_blocked)."""
    ok = F.col("status") == 200
    blocked = (F.col("status") == 403) & F.col("policy_blocked")
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(blocked).alias("policy_blocked"),
        F.count_if(~ok & ~blocked).alias("failed"),
        F.count_if(F.col("retries") > 0).alias("retried"),
        F.count_if("redirected").alias("redirected"),
    )
