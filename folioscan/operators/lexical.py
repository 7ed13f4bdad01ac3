"""Inverted-index retrieval: postings, BM25, conjunctive match, LIKE fallback."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import let, tokens, words
from folioscan.operators import term_scores
from folioscan.session import cut_lineage

# fixed values: Okapi parameters
K1, B = 1.2, 0.75
SCORE_DIGITS = 6


def tokenised(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(doc_id, tokens, dl) with dl the token count of the whole text."""
    return docs.select(F.col(id_col).alias("doc_id"), tokens(text).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, dl, tf); counted map-side before the one exchange."""
    return (
        docs.select("doc_id", "dl", F.explode_outer("tokens").alias("term"))
        .filter("term is not null")
        .groupBy("term", "doc_id", "dl")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms) with distinct terms of queries(query_id, query_text)."""
    t = queries.select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("terms"))
    return t.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def query_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings restricted to the terms of the queries, counted map-side before the exchange.

    They are written once to the shared folder, because document counts, candidates and weights all read
    them; the texts are tokenised once.
    """
    vocabulary = terms.select("term").distinct()
    # outer explode: a plain one makes the optimizer test the token array first, tokenising every text again
    hit = docs.select("doc_id", "dl", F.explode_outer("tokens").alias("term")).join(vocabulary, "term", "left_semi")
    return cut_lineage(hit.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf")))


def _weigh(post: DataFrame, df: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, doc_id, weight): BM25 weight of every posting."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    avgdl = docs.agg(F.avg("dl")).scalar()
    scored = post.join(df, "term").withColumn("n_docs", n).withColumn("avgdl", avgdl)
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.select("term", "doc_id", (idf * saturation).alias("weight"))


def _rarest_candidates(terms: DataFrame, df: DataFrame, post: DataFrame) -> DataFrame:
    """(query_id, doc_id) pairs of each query's rarest term; a term no document holds gives none."""
    known = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("df", "term")
    lead = known.withColumn("r", F.row_number().over(order)).filter("r = 1").select("query_id", "term")
    return lead.join(post.select("term", "doc_id"), "term").select("query_id", "doc_id")


def bm25(queries: DataFrame, docs: DataFrame, match: str = "any") -> DataFrame:
    """(query_id, doc_id, matched, score). match='all' keeps documents holding every query term.

    For 'all', candidates come from each query's rarest term only, so a term found in a third of the
    corpus is probed for those candidates instead of being expanded.
    """
    terms = query_terms(queries)
    post = query_postings(docs, terms)
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if match == "all":
        candidates = _rarest_candidates(terms, df, post)
        wanted = candidates.select("doc_id").distinct()
        weights = _weigh(post.join(wanted, "doc_id", "left_semi"), df, docs)
        pairs = candidates.join(terms, "query_id").join(weights, ["term", "doc_id"])
    else:
        # placed by document, so the sums per (query, document) need no exchange before the top-k cut
        pairs = terms.join(_weigh(post.repartition("doc_id"), df, docs), "term")
    scored = pairs.groupBy("query_id", "doc_id").agg(
        F.max("n_terms").alias("n_terms"),
        F.count(F.lit(1)).alias("matched"),
        F.round(F.sum("weight"), SCORE_DIGITS).alias("score"),
    )
    if match == "all":
        scored = scored.filter(F.col("matched") == F.col("n_terms"))
    return scored.select("query_id", "doc_id", "matched", "score")


def rank_top_k(scored: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """row_number per query by score, ties by id; Catalyst cuts each partition to k before the exchange."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _prepared(queries: DataFrame, docs: DataFrame) -> tuple[term_scores.QueryTerms, DataFrame] | None:
    """The queries' terms and the documents' rows of them; None where the terms pass the checked size."""
    asked = term_scores.gathered(query_terms(queries))
    return asked and (asked, term_scores.term_rows(docs, asked))


def _typed(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return rows.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))


def top_k(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The rows of `rank_top_k(bm25(queries, docs), k)`, scored where the documents lie (see `term_scores`)."""
    held = _prepared(queries, docs)
    if held is None:
        return rank_top_k(bm25(queries, docs), k)
    asked, rows = held
    weights, _ = term_scores.bm25_weights(rows, asked, K1, B)
    found = term_scores.scored(rows, asked, weights, k, SCORE_DIGITS).filter("doc_id is not null").drop("added")
    return rank_top_k(_typed(found, queries), k)


def with_all_terms(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of `bm25(queries, docs, match="all")`, scored where the documents lie."""
    held = _prepared(queries, docs)
    if held is None:
        return bm25(queries, docs, match="all")
    asked, rows = held
    weights, _ = term_scores.bm25_weights(rows, asked, K1, B)
    return _typed(term_scores.scored(rows, asked, weights, None, SCORE_DIGITS, match="all").filter("doc_id is not null").drop("added"), queries)


def bounded_top_k(queries: DataFrame, docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the k best documents per query, one row of counts), equal to `rank_top_k(bm25(queries, docs), k)`.

    Term weights have maxima, so a document can be left out unscored. A floor comes first: the documents of each query's
    most telling terms are scored in full, and the k-th best score is one that the result reaches at least.
    Terms whose maxima together stay below the floor can't bring a document into the result by themselves; only
    documents with one of the other, essential terms are candidates, and of these only those whose known weights plus all
    that the rest could add reach the floor are scored on the frequent terms. What is compared are upper bounds,
    so the result is exact. The counts (n_scored of n_postings) say how many (query, posting) pairs were added up.
    """
    spark = queries.sparkSession
    held = _prepared(queries, docs)
    if held is None:  # more query terms than one task may hold: full scoring, nothing is left out
        return rank_top_k(bm25(queries, docs), k), spark.createDataFrame([(None, None)], "n_scored long, n_postings long")
    asked, rows = held
    weights, df = term_scores.bm25_weights(rows, asked, K1, B)
    top = term_scores.per_term(rows, len(asked.vocabulary), weights)
    # each query's terms from the least to the most telling: what those up to each can add, and the postings of those after it
    order = np.lexsort((top[asked.term], asked.query))
    first = np.searchsorted(asked.query[order], asked.query[order])
    run = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    sums, met = run(top[asked.term[order]]), run(df[asked.term[order]])
    end = np.searchsorted(asked.query[order], asked.query[order], side="right")
    place = np.arange(len(order))
    below, lead = np.empty(len(order)), np.empty(len(order), bool)
    below[order] = sums[place + 1] - sums[first]
    # from the most telling term down, as many terms as it takes to meet k postings
    lead[order] = met[end] - met[place + 1] < k
    n = len(asked.ids)
    open_floor = np.full(n, -np.inf)
    guess = term_scores.Bound(lead, np.full(n, np.inf), open_floor)
    a = cut_lineage(term_scores.scored(rows, asked, weights, k, SCORE_DIGITS, bound=guess))
    reached = rank_top_k(a.filter("doc_id is not null"), k).filter(F.col("rank") == k).select("query_id", "score").toArrow()  # a row per query
    floor = open_floor.copy()
    at = pc.index_in(reached["query_id"].combine_chunks(), value_set=asked.ids.cast(reached["query_id"].type))
    floor[np.asarray(at)] = reached["score"].to_numpy()
    essential = below >= floor[asked.query] - 10.0**-SCORE_DIGITS
    rest = np.bincount(asked.query[~essential], weights=top[asked.term[~essential]], minlength=n)
    b = cut_lineage(term_scores.scored(rows, asked, weights, k, SCORE_DIGITS, bound=term_scores.Bound(essential, rest, floor)))
    counts = a.select("added").unionByName(b.select("added")).agg(F.coalesce(F.sum("added"), F.lit(0)).alias("n_scored"))
    found = b.filter("doc_id is not null").select("query_id", "doc_id", "score")
    return rank_top_k(_typed(found, queries), k), counts.withColumn("n_postings", F.lit(int(df[asked.term].sum())))


def weighted_fields(queries: DataFrame, fields: list[tuple[DataFrame, float]]) -> DataFrame:
    """Sum of per-field BM25 times the field's weight; fields are tokenised inputs."""
    parts = None
    for docs, weight in fields:
        one = bm25(queries, docs).select("query_id", "doc_id", (F.col("score") * weight).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))


def conjunctive(queries: DataFrame, docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """Documents holding every non-stop query term, ranked by summed term frequency over length."""
    kept = query_terms(queries).filter(~F.col("term").isin(stop_words)).drop("n_terms")
    counted = kept.join(kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms")), "query_id")
    post = query_postings(docs, kept)
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    candidates = _rarest_candidates(counted, df, post)
    return (
        candidates.join(counted, "query_id").join(post, ["term", "doc_id"])
        .groupBy("query_id", "doc_id")
        .agg(
            F.count(F.lit(1)).alias("matched"),
            F.max("n_terms").alias("n_terms"),
            F.round(F.sum(F.col("tf") / (1 + F.log("dl"))), SCORE_DIGITS).alias("score"),
        )
        .filter(F.col("matched") == F.col("n_terms"))
        .select("query_id", "doc_id", "score")
    )


def like_search(docs: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Case-insensitive containment in any of the columns, uniform score 1.0."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(needle.lower()))
    return docs.filter(hit).withColumn("score", F.lit(1.0))


def snippet(text: Column, needle: str, width: int = 8) -> Column:
    """Up to `width` words around the first hit, the hits wrapped in <b>, cuts marked by an ellipsis."""
    is_hit = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")) == needle.lower()

    def cut(s: Column) -> Column:
        all_words, at = s["w"], s["at"]
        start = F.greatest(F.lit(1), F.least(at - width // 2, F.size(all_words) - (width - 1)))
        shown = F.slice(all_words, start, F.lit(width))
        marked = F.transform(shown, lambda w: F.when(is_hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
        before = F.when(start > 1, F.lit("…")).otherwise(F.lit(""))
        after = F.when(start + width - 1 < F.size(all_words), F.lit("…")).otherwise(F.lit(""))
        return F.when(at > 0, F.concat(before, F.array_join(marked, " "), after))

    def find(w: Column) -> Column:
        at = F.array_position(F.transform(w, is_hit), F.lit(True)).cast("int")
        return let(F.struct(w.alias("w"), at.alias("at")), cut)

    return let(words(text), find)
