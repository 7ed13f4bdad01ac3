"""Retrieval metrics over results(query_id, rank, doc_id, ...), qrels(query_id, doc_id) and queries(query_id, success).

Queries without results or without judgments count by the same conventions everywhere: precision divides by
the number retrieved (0 when nothing was), recall, AP and nDCG are 1 when nothing is relevant, failed
queries are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results with rel = 1/0; the judgments are unique per (query, doc)."""
    marks = qrels.select("query_id", "doc_id", F.lit(1).alias("rel"))
    return results.join(marks, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(
    results: DataFrame, qrels: DataFrame, queries: DataFrame, ks: list[int], modes: list[str] | None = None
) -> DataFrame:
    """One row per successful query with every rank metric; with `modes`, one per query and value of results.mode."""
    by = ["mode", "query_id"] if modes else ["query_id"]
    rows = judged(results, qrels)
    running = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("seen", F.sum("rel").over(running))
    cells = [
        F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank"))).alias("_ap"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("_first"),
    ]
    for k in ks:
        top = F.col("rank") <= k
        cells += [
            F.count_if(top).alias(f"_ret{k}"),
            F.count_if(top & (F.col("rel") == 1)).alias(f"_hit{k}"),
            F.sum(F.when(top & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1))).alias(f"_dcg{k}"),
        ]
    found = rows.groupBy(*by).agg(*cells)
    n_rel = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    base = queries.filter("success").select("query_id")
    if modes:
        base = base.select("query_id", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    full = base.join(n_rel, "query_id", "left").join(found, by, "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    none = F.col("n_rel") == 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = [
        F.when(none, 1.0).otherwise(zero("_ap") / F.col("n_rel")).alias("ap"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("rr"),
    ]
    for k in ks:
        ideal = sum((F.when(F.col("n_rel") >= i, 1 / F.log2(F.lit(i + 1))).otherwise(0.0) for i in range(1, k + 1)), F.lit(0.0))
        out += [
            F.when(zero(f"_ret{k}") == 0, 0.0).otherwise(F.col(f"_hit{k}") / F.col(f"_ret{k}")).alias(f"p{k}"),
            F.when(none, 1.0).otherwise(zero(f"_hit{k}") / F.col("n_rel")).alias(f"r{k}"),
            F.when(none, 1.0).otherwise(zero(f"_dcg{k}") / ideal).alias(f"ndcg{k}"),
        ]
    return full.select(*by, "n_rel", *out)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def summary(metrics: DataFrame, ks: list[int], keys: list[str] | None = None) -> DataFrame:
    """Means over the queries; F1 is taken from the averaged precision and recall."""
    cells = [F.round(F.avg("ap"), DIGITS).alias("map"), F.round(F.avg("rr"), DIGITS).alias("mrr")]
    for k in ks:
        p, r = F.avg(f"p{k}"), F.avg(f"r{k}")
        cells += [
            F.round(p, DIGITS).alias(f"precision_at_{k}"), F.round(r, DIGITS).alias(f"recall_at_{k}"),
            F.round(f1(p, r), DIGITS).alias(f"f1_at_{k}"), F.round(F.avg(f"ndcg{k}"), DIGITS).alias(f"ndcg_at_{k}"),
        ]
    return metrics.groupBy(*(keys or [])).agg(*cells)


def success_rates(queries: DataFrame) -> DataFrame:
    ok = F.avg(F.col("success").cast("double"))
    return queries.agg(
        F.round(F.coalesce(ok, F.lit(0.0)), DIGITS).alias("success_rate"), F.round(1 - F.coalesce(ok, F.lit(1.0)), DIGITS).alias("error_rate")
    )


def spread(results: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Diversity (distinct documents / results) and coverage (distinct documents / corpus)."""
    kept = results.join(queries.filter("success"), "query_id", "left_semi").filter("doc_id is not null")
    size = corpus.agg(F.count(F.lit(1))).scalar()
    one = kept.agg(F.countDistinct("doc_id").alias("d"), F.count(F.lit(1)).alias("n")).withColumn("corpus", size)
    share = lambda c: F.when(F.col(c) > 0, F.round(F.col("d") / F.col(c), DIGITS)).otherwise(0.0)
    return one.select(share("n").alias("diversity"), share("corpus").alias("coverage"))


def consistency(results: DataFrame) -> DataFrame:
    """One row: the mean over repeated queries of the mean pairwise Jaccard of their runs' document sets.

    `results` has query, run, doc_id and success; failed runs don't count, queries are folded to lower case without
    outer blanks, and with at most one query, or none that was run twice, the value is 1. Runs of one set are folded into one row with a
    weight, so copies cost nothing; runs without a common document contribute 0 and are only counted. What remains
    meets on (query, doc_id).
    """
    results = results.filter("success").withColumn("query", F.lower(F.trim("query")))
    sets = results.groupBy("query", "run").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))  # one result list
    kinds = sets.groupBy("query", "docs").agg(F.count(F.lit(1)).alias("m"))
    kinds = kinds.withColumn("sig", F.sha2(F.array_join(F.transform("docs", lambda x: x.cast("string")), ","), 256))
    total = kinds.groupBy("query").agg(F.sum("m").alias("runs"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("same"))
    flat = kinds.select("query", "sig", "m", F.size("docs").alias("n"), F.explode("docs").alias("doc_id"))
    x, y = flat.alias("x"), flat.alias("y")
    met = x.join(
        y, (F.col("x.query") == F.col("y.query")) & (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.sig") < F.col("y.sig"))
    )
    shared = met.groupBy(
        F.col("x.query").alias("query"), F.col("x.sig").alias("i"), F.col("y.sig").alias("j"),
        (F.col("x.m") * F.col("y.m")).alias("weight"), (F.col("x.n") + F.col("y.n")).alias("both"),
    ).agg(F.count(F.lit(1)).alias("common"))
    mixed = shared.groupBy("query").agg(F.sum(F.col("weight") * F.col("common") / (F.col("both") - F.col("common"))).alias("mixed"))
    pairs = F.col("runs") * (F.col("runs") - 1) / 2
    mean = (F.col("same") + F.coalesce("mixed", F.lit(0.0))) / pairs
    each = total.join(mixed, "query", "left").select(F.when(F.col("runs") > 1, mean).alias("c"))
    return each.agg(F.when(F.count(F.lit(1)) > 1, F.coalesce(F.avg("c"), F.lit(1.0))).otherwise(1.0).alias("consistency"))


def coherence(results: DataFrame) -> DataFrame:
    """Mean of min(4 * sample variance of the scores, 1) per query; one score counts 0; no results 0.5."""
    per = results.groupBy("query_id").agg(F.least(F.coalesce(F.var_samp("score"), F.lit(0.0)) * 4, F.lit(1.0)).alias("c"))
    return per.agg(F.round(F.coalesce(F.avg("c"), F.lit(0.5)), DIGITS).alias("coherence"))


def relative_improvement(base: Column, new: Column) -> Column:
    """Percent change; infinite on a zero baseline with a positive new value."""
    return F.when(base == 0, F.when(new > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise((new - base) / base * 100)


def heuristic_p_value(base: Column, new: Column) -> Column:
    """A heuristic, not a statistical test: 1 - relative change either way, at least 0.001."""
    return F.greatest(F.lit(0.001), 1 - F.abs(new - base) / F.greatest(base, F.lit(0.001)))


def alerts(modes: DataFrame, max_latency_ms: float, min_success: float, min_f1: float) -> DataFrame:
    """(mode, type, severity, value, threshold) for every broken limit of modes(mode, avg_ms, success_rate, f1)."""

    def rule(cond: Column, kind: str, severity: str, value: str, limit: float) -> Column:
        row = F.struct(
            F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
            F.col(value).cast("double").alias("value"), F.lit(float(limit)).alias("threshold"),
        )
        return F.when(cond, row)

    rules = F.array(
        rule(F.col("avg_ms") > max_latency_ms, "performance", "medium", "avg_ms", max_latency_ms),
        rule(F.col("success_rate") < min_success, "reliability", "high", "success_rate", min_success),
        rule(F.col("f1") < min_f1, "quality", "medium", "f1", min_f1),
    )
    return modes.select("mode", F.inline(F.filter(rules, lambda r: r.isNotNull())))


def recommendation(modes: DataFrame) -> DataFrame:
    """One row: the best mode by mean F1 and the advice derived from the three modes' F1."""
    at = lambda m: F.max(F.when(F.col("mode") == m, F.col("f1")))
    h, s, t = at("hybrid"), at("semantic"), at("fulltext")
    advice = (
        F.when(h > F.greatest(s, t), "hybrid recommended").when(s > t, "semantic preferred").otherwise("fulltext preferred")
    )
    best = F.max_by("mode", F.struct(F.col("f1"), F.col("mode")))
    return modes.agg(best.alias("best_mode"), F.round(F.max("f1"), DIGITS).alias("best_f1"), advice.alias("advice"))


def regressions(history: DataFrame, keys: list[str], value: str, drop: float) -> DataFrame:
    """Runs whose value fell by more than `drop` against the previous run."""
    order = Window.partitionBy(*keys).orderBy("run")
    seen = history.withColumn("previous", F.lag(value).over(order))
    return seen.filter(F.col("previous") - F.col(value) > drop)
