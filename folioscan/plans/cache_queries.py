"""Registered queries: cache tables derived from the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import caching, similarity
from folioscan.plans import fixtures as X
from folioscan.plans import sqltext as S
from folioscan.plans.registry import query
from folioscan.session import as_of, load, load_spread


@query("cache_put", "C2 W9", f"""
with {X.CACHE_SQL} select cache_key, strftime(accessed_at, '%Y-%m-%d %H:%M:%S') as accessed_at, strftime(expires_at, '%Y-%m-%d %H:%M:%S') as expires_at, value from cache""")
def cache_put(spark, d):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return caching.put(X.cache_puts(spark, d)).select("cache_key", shown("accessed_at"), shown("expires_at"), "value")


@query("cache_lookup", "C1 PF10 Z22", f"""
with {X.CACHE_SQL} select p.event_id, p.cache_key, p.ts + interval 6 hour < c.expires_at as hit from puts p join cache c using (cache_key)""")
def cache_lookup(spark, d):
    """Every write is read again six hours later from the final table."""
    puts = X.cache_puts(spark, d)
    asked = puts.select("cache_key", F.col("event_id").alias("request_id"), (F.col("accessed_at") + F.make_interval(hours=F.lit(6))).alias("at"))
    out = caching.lookup(asked, caching.put(puts), "at")
    return out.select(F.col("request_id").alias("event_id"), "cache_key", "hit")


@query("cache_expire", "C3 D3", f"""
with {X.CACHE_SQL} select cache_key from cache, moment where expires_at > as_of""")
def cache_expire(spark, d):
    return caching.live(caching.put(X.cache_puts(spark, d)), as_of(load(spark, d, "events"))).select("cache_key")


@query("cache_lru_evict", "C4 W10", f"""
with {X.CACHE_SQL} select cache_key from cache order by accessed_at desc, cache_key limit 1000""")
def cache_lru_evict(spark, d):
    return caching.evict(caching.put(X.cache_puts(spark, d)), 1000).select("cache_key")


@query("cache_stats", "AGG5 C8 D3", f"""
with {X.CACHE_SQL} select count(*) as total, sum((expires_at > as_of)::int)::bigint as active, sum((expires_at <= as_of)::int)::bigint as expired,
 round(avg((epoch_us(as_of) - epoch_us(accessed_at)) / 1e6), 3) as avg_age_seconds from cache, moment""")
def cache_stats(spark, d):
    return caching.stats(caching.put(X.cache_puts(spark, d)), as_of(load(spark, d, "events")))


@query("cache_replay_lru", "C5 AGG19", f"""
with o as (select user_id, {X.PROP_K} k, row_number() over (partition by user_id order by ts, event_id) i from events),
p as (select *, lag(i) over (partition by user_id, k order by i) p from o),
n as (select a.user_id, a.i, a.p, count(distinct b.k) between_keys from p a left join o b on b.user_id = a.user_id and b.i > a.p and b.i < a.i group by 1, 2, 3)
select user_id, sum((p is not null and between_keys < 10)::int)::bigint as hits, sum((p is null or between_keys >= 10)::int)::bigint as misses from n group by 1""")
def cache_replay_lru(spark, d):
    log = load(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("cache_key"), "ts", "event_id")
    return caching.replay(log, "user_id", 10)


@query("embedding_reuse", "C6 J14 ST9", f"""
with s as (select doc_id, list_sort(list_distinct({S.words('lower(text)')})) w, doc_id in (select vec_id from embeddings) cached from documents),
c as (select min(doc_id) b, any_value(w) w from s where cached and len(w) > 0 group by array_to_string(w, ' ')),
p as (select x.doc_id, c.b, len(list_intersect(x.w, c.w)) / len(list_distinct(x.w || c.w)) j from s x join c on not x.cached and len(x.w) >= 0.9 * len(c.w) and len(c.w) >= 0.9 * len(x.w))
select doc_id, min(b) as reuse_from, round(max(j), 6) as similarity from p where j > 0.9 group by 1""")
def embedding_reuse(spark, d):
    docs = load_spread(spark, d, "documents", "doc_id")
    vec = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    out = similarity.reuse_within(docs, vec, "doc_id", "text", 0.9)
    return out.select("doc_id", "reuse_from", F.round("similarity", 6).alias("similarity"))
