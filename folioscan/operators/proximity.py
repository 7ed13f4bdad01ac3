"""Ranking by how close together the terms of a query stand, and snippets from the best window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import let, words
from folioscan.operators.lexical import SCORE_DIGITS, _rarest_candidates, query_terms
from folioscan.session import cut_lineage

# fixed value: weight of a word without a label
WORD_WEIGHT = 0.1


def positions(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, pos) of the queries' terms; only these leave the texts."""
    hit = docs.select("doc_id", F.posexplode_outer("tokens").alias("pos", "term"))
    return hit.join(terms.select("term").distinct(), "term", "left_semi")


def cover_density(queries: DataFrame, docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """(query_id, doc_id, covers, score) of the documents that hold all terms of a query, stop words aside.

    A cover is a shortest stretch of the document with all terms in it. Each adds its weight divided by one more than the
    words in it that are no terms of the query. One fold over a document's term positions in order keeps the last
    place of every term: when the earliest of these moves, a new cover ends here. Work is the number of positions
    times the number of terms; documents without all terms are left out before positions are gathered.
    """
    kept = query_terms(queries).filter(~F.col("term").isin(stop_words)).drop("n_terms")
    number = F.row_number().over(_by_query())
    kept = cut_lineage(kept.withColumn("t", number - 1))
    sizes = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    found = cut_lineage(positions(docs, kept))
    post = found.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    candidates = _rarest_candidates(kept, df, post)
    whole = (
        candidates.join(kept, "query_id").join(post, ["term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("_has"))
        .join(sizes, "query_id").filter("_has = n_terms").select("query_id", "doc_id", "n_terms")
    )
    placed = whole.join(kept, "query_id").join(found, ["doc_id", "term"])
    rows = placed.groupBy("query_id", "doc_id", "n_terms").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("at"))
    return rows.select("query_id", "doc_id", _swept(F.col("at"), F.col("n_terms")).alias("_s")).select(
        "query_id", "doc_id", F.col("_s.covers").cast("long").alias("covers"), F.round("_s.score", SCORE_DIGITS).alias("score")
    )


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy("term")  # the terms of one query


def _swept(at: Column, n_terms: Column) -> Column:
    start = F.struct(
        F.array_repeat(F.lit(-1), n_terms.cast("int")).alias("last"), F.lit(-1).alias("low"), F.lit(0).alias("covers"), F.lit(0.0).alias("score")
    )

    def step(s: Column, i: Column) -> Column:
        term, pos = F.get(at, i)["t"], F.get(at, i)["pos"]

        def moved(last: Column) -> Column:
            def ended(low: Column) -> Column:
                new = low > s["low"]
                noise = pos - F.get(at, low)["pos"] - (i - low)
                gain = F.when(new, WORD_WEIGHT / (1 + noise)).otherwise(0.0)
                return F.struct(last.alias("last"), low.alias("low"), (s["covers"] + new.cast("int")).alias("covers"), (s["score"] + gain).alias("score"))

            return let(F.array_min(last), ended)

        return let(F.transform(s["last"], lambda v, t: F.when(t == term, i).otherwise(v)), moved)

    return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), start, step)


def best_window(text: Column, needles: Column, width: int = 8) -> Column:
    """The `width` words that hold the most different needles, the first of such windows; null without any hit.

    Needles are lower-cased words of letters and digits. Hits are wrapped in <b>, cuts marked by an ellipsis. A window
    begins at a hit, or earlier where the text ends; it is then moved left to show context before its first hit.
    """

    def cut(s: Column) -> Column:
        shown, place = s["w"], s["hit"]
        starts = F.filter(F.sequence(F.lit(1), F.size(shown)), lambda i: F.element_at(place, i) > 0)
        kinds = lambda i: F.size(F.array_distinct(F.filter(F.slice(place, i, F.lit(width)), lambda p: p > 0)))
        best = F.array_max(F.transform(starts, lambda i: F.struct(kinds(i).alias("kinds"), (-i).alias("back"))))

        def framed(b: Column) -> Column:
            first = -b["back"]
            span = F.array_max(F.transform(F.filter(F.sequence(first, F.least(first + width - 1, F.size(shown))), lambda i: F.element_at(place, i) > 0), lambda i: i)) - first + 1
            start = F.greatest(F.lit(1), F.least(first - F.floor((width - span) / 2).cast("int"), F.size(shown) - (width - 1)))

            def drawn(at: Column) -> Column:
                pairs = F.arrays_zip(F.slice(shown, at, F.lit(width)).alias("w"), F.slice(place, at, F.lit(width)).alias("p"))
                marked = F.transform(pairs, lambda x: F.when(x["p"] > 0, F.concat(F.lit("<b>"), x["w"], F.lit("</b>"))).otherwise(x["w"]))
                before, after = F.when(at > 1, F.lit("…")).otherwise(F.lit("")), F.when(at + width - 1 < F.size(shown), F.lit("…")).otherwise(F.lit(""))
                return F.struct(F.concat(before, F.array_join(marked, " "), after).alias("snippet"), b["kinds"].alias("kinds"))

            return let(start, drawn)

        return F.when(F.size(starts) > 0, let(best, framed))

    bare = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))

    def find(w: Column) -> Column:
        hit = F.transform(w, lambda x: F.coalesce(F.array_position(needles, bare(x)), F.lit(0)))
        return let(F.struct(w.alias("w"), hit.alias("hit")), cut)

    return F.when(F.size(words(text)) > 0, let(words(text), find))
