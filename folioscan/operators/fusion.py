"""Hybrid ranking: rank fusion, score fusion, diversification, click-feedback reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import words

SCORE_DIGITS = 6
# fixed values: linear weights of the eleven ranking features, in feature order
FEATURES = [
    "query_length", "query_terms", "doc_length", "title_match", "heading_match", "bm25_score",
    "semantic_similarity", "rrf_score", "original_rank", "click_rate", "avg_dwell_time",
]
DEFAULT_WEIGHTS = [0.1, 0.2, 0.05, 0.3, 0.2, 0.4, 0.5, 0.6, -0.1, 0.8, 0.3]


def _order(score: str, key: str):
    return Window.partitionBy("query_id").orderBy(F.desc(score), key)


def reciprocal_rank_fusion(
    lexical: DataFrame, semantic: DataFrame, limit: int, rrf_k: int = 60, first_rank: int = 1
) -> DataFrame:
    """Full outer join of two ranked lists (query_id, doc_id, rank), score = sum of 1/(rrf_k + rank).

    Both inputs are already cut to a few rows per query, so this join is small whatever the corpus size.
    """
    shift = first_rank - 1
    a = lexical.select("query_id", "doc_id", (F.col("rank") + shift).alias("lexical_rank"))
    b = semantic.select("query_id", "doc_id", (F.col("rank") + shift).alias("semantic_rank"))
    both = a.join(b, ["query_id", "doc_id"], "full")

    def part(c: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.col(c) + rrf_k), F.lit(0.0))

    scored = both.withColumn("rrf_score", part("lexical_rank") + part("semantic_rank"))
    # equal scores keep the semantic hit first, then the smaller id
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("rrf_score", 12)), F.asc_nulls_last("semantic_rank"), "doc_id"
    )
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def boosted_fusion(lexical: DataFrame, semantic: DataFrame, limit: int, rrf_k: int = 60) -> DataFrame:
    """Rank fusion with places from 0 whose lexical part is multiplied by 1 + min(bm25, 10)/10; ranked by the boosted sum."""
    a = lexical.select("query_id", "doc_id", (F.col("rank") - 1).alias("lexical_rank"), F.col("score").alias("bm25_score"))
    b = semantic.select("query_id", "doc_id", (F.col("rank") - 1).alias("semantic_rank"))
    dense = F.coalesce(1 / (F.col("semantic_rank") + rrf_k), F.lit(0.0))
    sparse = F.coalesce((1 + F.least(F.col("bm25_score"), F.lit(10.0)) / 10) / (F.col("lexical_rank") + rrf_k), F.lit(0.0))
    scored = a.join(b, ["query_id", "doc_id"], "full").withColumn("boosted", dense + sparse)
    # equal scores keep the semantic hit first, then the smaller id
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("boosted", 12)), F.asc_nulls_last("semantic_rank"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def weighted_sum(lexical: DataFrame, semantic: DataFrame, w_lexical: float, w_semantic: float) -> DataFrame:
    """Mean-style fusion of raw scores; a missing side contributes 0."""
    a = lexical.select("query_id", "doc_id", F.col("score").alias("lexical_score"))
    b = semantic.select("query_id", "doc_id", F.col("similarity").alias("semantic_score"))
    total = F.coalesce("lexical_score", F.lit(0.0)) * w_lexical + F.coalesce("semantic_score", F.lit(0.0)) * w_semantic
    return a.join(b, ["query_id", "doc_id"], "full").withColumn("score", F.round(total, 8))


def diversify(ranked: DataFrame, section: str, at_least: int = 3) -> DataFrame:
    """Keep the first hit of each section; repeats only while fewer than `at_least` hits are kept.

    The first `at_least` rows of a query are always kept, later rows only when their section is new, so
    two windows over a ranked (short) list are enough.
    """
    w = Window.partitionBy("query_id", section).orderBy("rank")
    first = ranked.withColumn("nth_of_section", F.row_number().over(w))
    kept = first.filter((F.col("rank") <= at_least) | (F.col("nth_of_section") == 1)).drop("nth_of_section")
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("diverse_rank", F.row_number().over(order))


def click_features(clicks: DataFrame, since: Column) -> DataFrame:
    """Per chunk: click_rate = min(clicks/100, 1) and mean dwell of the clicks not older than `since`."""
    return (
        clicks.filter(F.col("ts") >= since)
        .groupBy("chunk_id")
        .agg(F.count(F.lit(1)).alias("clicks"), F.avg("dwell_time").alias("avg_dwell_time"))
        .withColumn("click_rate", F.least(F.col("clicks") / 100.0, F.lit(1.0)))
    )


def ranking_features(results: DataFrame, history: DataFrame) -> DataFrame:
    """Add the eleven features to results(query_id, query_text, doc_id, text, title, heading, rank, ...).

    One grouped left join replaces a click lookup per result.
    """
    joined = results.join(
        history.select(F.col("chunk_id").alias("doc_id"), "click_rate", "avg_dwell_time"), "doc_id", "left"
    )
    q = F.lower("query_text")
    return joined.select(
        "query_id", "doc_id", "original_score",
        F.length("query_text").alias("query_length"),
        F.size(words(F.col("query_text"))).alias("query_terms"),
        F.length("text").alias("doc_length"),
        F.contains(F.lower("title"), q).cast("int").alias("title_match"),
        F.contains(F.lower("heading"), q).cast("int").alias("heading_match"),
        "bm25_score", "semantic_similarity", "rrf_score",
        (F.col("rank") - 1).alias("original_rank"),
        F.coalesce("click_rate", F.lit(0.0)).alias("click_rate"),
        F.coalesce("avg_dwell_time", F.lit(0.0)).alias("avg_dwell_time"),
    )


def linear_score(weights: list[float] = DEFAULT_WEIGHTS) -> Column:
    return sum((F.col(f) * F.lit(w) for f, w in zip(FEATURES, weights)), F.lit(0.0))


def rerank(features: DataFrame, weights: list[float] = DEFAULT_WEIGHTS, keep: float = 0.7, digits: int = SCORE_DIGITS) -> DataFrame:
    """Blend of the original score and the linear model, ranked again per query."""
    score = F.round(keep * F.col("original_score") + (1 - keep) * linear_score(weights), digits)
    return features.withColumn("score", score).withColumn("new_rank", F.row_number().over(_order("score", "doc_id")))


def updated_weights(clicks: DataFrame, since: Column, rate: float = 0.01, newest: int = 1000, least: int = 10) -> DataFrame:
    """One row of eleven weights after a feedback step over the newest clicks.

    A good mean position (< 3) strengthens click_rate and avg_dwell_time, otherwise click_rate weakens;
    the result is scaled to unit length. Fewer than `least` clicks leave the defaults unchanged.
    """
    recent = clicks.filter(F.col("ts") >= since).orderBy(F.desc("ts"), "event_id").limit(newest)
    one = recent.agg(F.count(F.lit(1)).alias("n"), F.avg("position").alias("mean_position"))
    good = F.col("mean_position") < 3
    factor = {
        "click_rate": F.when(good, 1 + rate).otherwise(1 - rate),
        "avg_dwell_time": F.when(good, 1 + rate).otherwise(F.lit(1.0)),
    }
    stepped = [F.lit(w) * factor.get(f, F.lit(1.0)) for f, w in zip(FEATURES, DEFAULT_WEIGHTS)]
    length = F.sqrt(sum((s * s for s in stepped), F.lit(0.0)))
    enough = F.col("n") >= least
    return one.select(
        "n", "mean_position",
        *[F.when(enough, s / length).otherwise(F.lit(w)).alias(f"w_{f}") for f, w, s in zip(FEATURES, DEFAULT_WEIGHTS, stepped)],
    )


def pair_rerank(results: DataFrame, scorer=None) -> DataFrame:
    """Rank again by a pluggable (query text, document text) scorer; a scorer may read as much as it wants.

    Without a scorer the given order stays, which is also how a missing model degrades.
    """
    if scorer is None:
        return results.withColumn("new_rank", F.col("rank"))
    scored = results.withColumn("pair_score", scorer(F.col("query_text"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.desc("pair_score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order))
