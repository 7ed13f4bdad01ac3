"""Result cache as a table: look-up, expiry, eviction and log replay."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def put(puts: DataFrame) -> DataFrame:
    """Current entry per key: the latest write wins (combined map-side)."""
    rest = [c for c in puts.columns if c != "cache_key"]
    newest = puts.groupBy("cache_key").agg(F.max_by(F.struct(*rest), F.struct("accessed_at", "event_id")).alias("r"))
    return newest.select("cache_key", *[F.col(f"r.{c}").alias(c) for c in rest])


def lookup(requests: DataFrame, entries: DataFrame, at: str) -> DataFrame:
    """Requests with the unexpired entry of their key; an expired entry counts as a miss."""
    found = requests.join(entries, "cache_key", "left")
    return found.withColumn("hit", F.coalesce(F.col("expires_at") > F.col(at), F.lit(False)))


def live(entries: DataFrame, moment: Column) -> DataFrame:
    return entries.filter(F.col("expires_at") > moment)


def evict(entries: DataFrame, keep: int) -> DataFrame:
    """The `keep` most recently used entries."""
    return entries.orderBy(F.desc("accessed_at"), "cache_key").limit(keep)


def stats(entries: DataFrame, moment: Column) -> DataFrame:
    e = entries.withColumn("_now", moment)
    age = (F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("accessed_at").cast("timestamp"))) / 1e6
    return e.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("expires_at") > F.col("_now")).alias("active"),
        F.count_if(F.col("expires_at") <= F.col("_now")).alias("expired"), F.round(F.avg(age), 3).alias("avg_age_seconds"),
    )


def replay(log: DataFrame, shard: str, capacity: int) -> DataFrame:
    """Hits and misses of one LRU cache of `capacity` keys per shard over an ordered access log.

    LRU state is a small ordered dict per shard; rows stream through it in sorted order in Arrow batches, so
    no shard is ever held in memory. log(shard, cache_key, ts, event_id).
    """
    ordered = log.repartition(shard).sortWithinPartitions(shard, "ts", "event_id").select(shard, "cache_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cache, hits, misses = None, OrderedDict(), 0, 0
        for batch in batches:
            for name, key in zip(batch[shard].tolist(), batch["cache_key"].tolist()):
                if name != current:
                    if current is not None:
                        yield pd.DataFrame({shard: [current], "hits": [hits], "misses": [misses]})
                    current, cache, hits, misses = name, OrderedDict(), 0, 0
                if key in cache:
                    hits += 1
                    cache.move_to_end(key)
                else:
                    misses += 1
                    cache[key] = True
                    if len(cache) > capacity:
                        cache.popitem(last=False)
        if current is not None:
            yield pd.DataFrame({shard: [current], "hits": [hits], "misses": [misses]})

    out = T.StructType([log.schema[shard], T.StructField("hits", T.LongType()), T.StructField("misses", T.LongType())])
    return ordered.mapInPandas(run, out)
