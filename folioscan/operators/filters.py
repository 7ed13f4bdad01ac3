"""Predicates, pagination and small row classifications."""

from __future__ import annotations

from collections.abc import Mapping

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import ids, urls
from folioscan.functions.text import glob_regex, matches_any

# fixed values
RETRYABLE = [408, 429, 500, 502, 503, 504]


def where_all(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Conjunction of equality conditions; lists become IN lists."""
    for name, wanted in conditions.items():
        col = F.col(name)
        df = df.filter(col.isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else col == F.lit(wanted))
    return df


def differs(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows whose value is another one or missing."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(wanted)))


def within(df: DataFrame, ts: str, moment: Column, days: int = 0, hours: int = 0) -> DataFrame:
    return df.filter(F.col(ts) >= moment - F.make_interval(days=F.lit(days), hours=F.lit(hours)))


def keyset_page(df: DataFrame, key: str, after: str, size: int) -> DataFrame:
    """The page of rows after a cursor, with the next cursor on a full page."""
    page = df.filter(F.col(key) > after).orderBy(key).limit(size)
    whole = Window.partitionBy()  # at most `size` rows
    cursor = F.when(F.count(F.lit(1)).over(whole) == size, F.max(key).over(whole))
    return page.withColumn("next_cursor", cursor)


def within_rules(url: Column, home: str, allow: list[str], deny: list[str]) -> Column:
    """Under the home URL, not denied, and allowed (an empty allow list allows all); deny wins."""
    p = urls.path(url)
    p = F.when(p == "", F.lit("/")).otherwise(p)
    denied = matches_any(p, [glob_regex(g) for g in deny])
    allowed = matches_any(p, [glob_regex(g) for g in allow]) if allow else F.lit(True)
    return url.startswith(home) & ~denied & allowed


def follow_link(url: Column, base_domain: Column, include: list[str], exclude: list[str]) -> Column:
    """Same domain (or no domain), some include text in the URL if any are given, and no exclude text."""
    domain = urls.netloc(url)
    same = (domain == "") | (domain == base_domain)
    holds = lambda parts: reduce(lambda a, b: a | b, [F.contains(url, F.lit(p)) for p in parts], F.lit(False))
    return same & (holds(include) if include else F.lit(True)) & ~holds(exclude)


def url_pattern_verdict(url: Column, whitelist: list[str], blacklist: list[str]) -> Column:
    white = matches_any(url, [f"(?i){p}" for p in whitelist])
    black = matches_any(url, [f"(?i){p}" for p in blacklist])
    return F.when(black, "url_blacklisted").when(white, "whitelisted").otherwise("check_robots")


def is_retryable(status: Column) -> Column:
    return status.isin(RETRYABLE)


def crawl_outcome(status: Column) -> Column:
    return (
        F.when(status == 403, "blocked").when(status == 200, "successful")
        .when(status.between(300, 399), "redirected").otherwise("failed")
    )


def retry_delay(attempt: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap))


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Exact 1-based positions in a global order without one task seeing all rows.

    Rows are counted per range partition first; each partition then numbers its own rows from its offset.
    """
    from folioscan.operators.ranks import global_position

    return global_position(df, order, "position")


def exact_copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents whose text occurs more than once, with the smallest id and the number of copies.

    Groups are reduced to one row per hash before they meet the documents again, so a hash shared by a
    third of the rows is combined map-side and its join side is a single row (split by AQE if skewed).
    """
    hashed = docs.select(F.col(key), ids.content_hash(F.col(text)).alias("h"))
    groups = hashed.groupBy("h").agg(F.min(key).alias("first_doc"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return hashed.join(groups, "h").select(key, "first_doc", "copies")
