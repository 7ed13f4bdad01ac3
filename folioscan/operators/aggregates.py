"""Grouped statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def click_stats(clicks: DataFrame, keys: list[str]) -> DataFrame:
    return clicks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_clicks"),
        F.countDistinct("query").alias("unique_queries"),
        F.countDistinct("session_id").alias("unique_sessions"),
        F.round(F.avg("position"), 10).alias("avg_position"),
        F.round(F.avg("dwell_time"), 10).alias("avg_dwell"),
    )


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, version, n): value counts of several columns in one pass by grouping sets."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns]
    )
    kind = version = None
    for c in columns:
        here = F.col(f"_{c}") == 0
        shown = F.coalesce(F.col(c), F.lit("null"))
        kind = F.when(here, c) if kind is None else kind.when(here, c)
        version = F.when(here, shown) if version is None else version.when(here, shown)
    return sets.select(kind.alias("kind"), version.alias("version"), "n")


def top_terms(docs: DataFrame, key: str, words: str, k: int) -> DataFrame:
    flat = docs.select(key, F.explode_outer(words).alias("term")).filter("term is not null")
    counts = flat.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dataset_statistics(qrels: DataFrame) -> DataFrame:
    """Per query type: pairs, relevant documents per query, distinct relevant documents, and pairs per difficulty."""
    pairs = qrels.groupBy("query_type", "query").agg(F.count(F.lit(1)).alias("relevant"), F.max("difficulty").alias("difficulty"))
    documents = qrels.groupBy("query_type").agg(F.countDistinct("doc_id").alias("unique_relevant_docs"))
    return pairs.groupBy("query_type").agg(
        *[F.count_if(F.col("difficulty") == x).alias(x) for x in ("easy", "medium", "hard")],
        F.count(F.lit(1)).alias("total_pairs"),
        F.countDistinct("query").alias("unique_queries"),
        F.min("relevant").alias("min_relevant"),
        F.max("relevant").alias("max_relevant"),
        F.round(F.avg("relevant"), 6).alias("avg_relevant"),
        F.sum("relevant").alias("total_relevant"),
    ).join(documents, "query_type")


def hash_split(df: DataFrame, key: str, train: float, seed: int) -> DataFrame:
    """Seeded split that depends on the key only, hence the same on every run and partitioning."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), 1, 7)
    share = F.conv(digest, 16, 10).cast("long") / (1 << 28)
    return df.withColumn("part", F.when(share < train, "train").otherwise("test"))


def counted_examples(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """Group sizes with the k smallest items; each partition keeps k rows per group before they meet."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(item)
    first = df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    shown = first.groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string")), ",").alias("examples")
    )
    return sizes.join(shown, group)


def cumulative_buckets(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative histogram rows (keys, le, n) for fixed bounds plus +Inf, as conditional sums in one pass."""
    names = [f"{b:g}" for b in bounds] + ["+Inf"]
    counts = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(F.lit(1))]
    wide = df.groupBy(*keys).agg(*[c.alias(f"_b{i}") for i, c in enumerate(counts)])
    cells = F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"_b{i}").alias("n")) for i, n in enumerate(names)])
    return wide.select(*keys, F.inline(cells))


def histogram_quantile(df: DataFrame, keys: list[str], value: str, bounds: list[float], q: float) -> DataFrame:
    """Quantile estimated from cumulative buckets by linear interpolation inside the bucket."""
    edges = [0.0, *bounds]
    counts = [F.count_if(F.col(value) <= b) for b in bounds]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"_b{i}") for i, c in enumerate(counts)])
    goal = F.col("n") * q
    out = None
    for i in range(len(bounds)):
        below = F.lit(0) if i == 0 else F.col(f"_b{i - 1}")
        inner = edges[i] + (edges[i + 1] - edges[i]) * (goal - below) / (F.col(f"_b{i}") - below)
        hit = F.col(f"_b{i}") >= goal
        out = F.when(hit, inner) if out is None else out.when(hit, inner)
    return wide.select(*keys, "n", out.otherwise(F.lit(bounds[-1])).alias("quantile"))
