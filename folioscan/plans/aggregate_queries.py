"""Registered queries: aggregates over clicks, documents and lineage columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions.text import keyword_tokens
from folioscan.operators import aggregates, filters, fusion
from folioscan.plans import fixtures as X
from folioscan.plans.registry import query
from folioscan.session import as_of, load, load_spread


@query("click_stats_overall", "AGG2", f"""
with {X.CLICKS_SQL} select count(*) as total_clicks, count(distinct query) as unique_queries, count(distinct session_id) as unique_sessions,
 round(avg(position), 10) as avg_position, round(avg(dwell_time), 10) as avg_dwell from clicks where ts >= (select max(ts) from events) - interval 30 day""")
def click_stats_overall(spark, d):
    c = filters.within(X.clicks(spark, d), "ts", as_of(load(spark, d, "events")), days=30)
    return aggregates.click_stats(c, []).select("total_clicks", "unique_queries", "unique_sessions", "avg_position", "avg_dwell")


@query("click_stats_by_query", "AGG1 AGG29 PF7", f"""
with {X.CLICKS_SQL} select query, count(*) as total_clicks, count(distinct session_id) as unique_sessions,
 round(avg(position), 10) as avg_position, round(avg(dwell_time), 10) as avg_dwell from clicks where ts >= (select max(ts) from events) - interval 14 day group by 1""")
def click_stats_by_query(spark, d):
    c = filters.within(X.clicks(spark, d), "ts", as_of(load(spark, d, "events")), days=14)
    return aggregates.click_stats(c, ["query"]).select("query", "total_clicks", "unique_sessions", "avg_position", "avg_dwell")


@query("chunk_click_features", "AGG3", f"""
with {X.CLICKS_SQL} select chunk_id, count(*) as clicks, least(count(*) / 100.0, 1.0) as click_rate, round(avg(dwell_time), 10) as avg_dwell
from clicks where ts >= (select max(ts) from events) - interval 30 day group by 1""")
def chunk_click_features(spark, d):
    since = as_of(load(spark, d, "events")) - F.make_interval(days=F.lit(30))
    f = fusion.click_features(X.clicks(spark, d), since)
    return f.select("chunk_id", "clicks", "click_rate", F.round("avg_dwell_time", 10).alias("avg_dwell"))


@query("database_stats", "AGG4", f"""
with {X.CHUNKS_SQL}, {X.CLICKS_SQL} select (select count(*) from documents) as documents, (select count(*) from chunks) as chunks,
 (select count(*) from chunks where has_embedding) as chunks_with_embeddings, (select count(*) from clicks) as clicks,
 (select count(distinct user_id) from events) as sessions, (select count(distinct source) from documents) as sources""")
def database_stats(spark, d):
    docs, ch, ev = load(spark, d, "documents"), X.chunks(spark, d), load(spark, d, "events")
    one = lambda df, c: df.agg(c).scalar()
    n = F.count(F.lit(1))
    return spark.range(1).select(
        one(docs, n).alias("documents"), one(ch, n).alias("chunks"), one(ch, F.count_if("has_embedding")).alias("chunks_with_embeddings"),
        one(X.clicks(spark, d), n).alias("clicks"), one(ev, F.countDistinct("user_id")).alias("sessions"),
        one(docs, F.countDistinct("source")).alias("sources"),
    )


@query("version_distribution_gsets", "AGG6 LN1", f"""
with {X.CHUNKS_SQL} select case when grouping(embedding_model) = 0 then 'embedding_model' else 'chunker_version' end as kind,
 case when grouping(embedding_model) = 0 then coalesce(embedding_model, 'null') else coalesce(chunker_version, 'null') end as version, count(*) as n
from chunks group by grouping sets ((embedding_model), (chunker_version))""")
def version_distribution_gsets(spark, d):
    return aggregates.distributions(X.chunks(spark, d), ["embedding_model", "chunker_version"])


@query("processing_coverage", "AGG7 AGG8 I5", f"""
with {X.STATE_SQL} select count(*) as total_documents, count(last_processed_at) as processed, count(*) - count(last_processed_at) as unprocessed,
 round(count(last_processed_at) / count(*) * 100, 6) as coverage, sum(case when last_processed_at >= timestamp '2024-01-01 06:00:00' then 1 else 0 end)::bigint as recent from doc_state""")
def processing_coverage(spark, d):
    from folioscan.operators.lineage import coverage

    return coverage(X.document_state(spark, d), F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"))


@query("keyword_extraction", "AGG26", """
with k as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) w from documents),
c as (select doc_id, w, count(*) n from k where regexp_matches(w, '^[a-z]{3,}$') and w not in ('the','and','for','are','but','not','you','all','can','had','has','have','this','that','with','will') group by 1, 2)
select doc_id, w as keyword, n, row_number() over (partition by doc_id order by n desc, w) as rank from c qualify rank <= 10""")
def keyword_extraction(spark, d):
    docs = load_spread(spark, d, "documents", "doc_id").select("doc_id", keyword_tokens(F.col("text")).alias("words"))
    return aggregates.top_terms(docs, "doc_id", "words", 10).select("doc_id", F.col("term").alias("keyword"), "n", "rank")


@query("site_stats", "AGG24 AGG25", f"""
with {X.CHUNKS_SQL} select source as site, count(distinct doc_id) as documents, count(chunk_id) as chunks,
 round(count(chunk_id) / greatest(count(distinct doc_id), 1), 2) as avg_chunks_per_doc
from documents left join (select document_id, chunk_id from chunks) on document_id = doc_id group by 1""")
def site_stats(spark, d):
    ch = X.chunks(spark, d).groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    per_doc = load(spark, d, "documents").join(ch, "doc_id", "left")
    chunks = F.coalesce(F.sum("n"), F.lit(0))
    docs = F.count(F.lit(1))
    return per_doc.groupBy(F.col("source").alias("site")).agg(
        docs.alias("documents"), chunks.alias("chunks"), F.round(chunks / F.greatest(docs, F.lit(1)), 2).alias("avg_chunks_per_doc")
    )


@query("dataset_statistics", "AGG21 PF20 SRC12", """
with p as (select e.label query, case when label < 5 then 'specific' else 'general' end query_type, count(*) relevant,
  any_value(case label % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end) difficulty from embeddings e group by 1, 2),
u as (select case when label < 5 then 'specific' else 'general' end query_type, count(distinct vec_id) n from embeddings group by 1)
select query_type, any_value(u.n) as unique_relevant_docs, count_if(difficulty = 'easy')::bigint as easy, count_if(difficulty = 'medium')::bigint as medium,
 count_if(difficulty = 'hard')::bigint as hard, count(*) as total_pairs, count(distinct query) as unique_queries, min(relevant) as min_relevant, max(relevant) as max_relevant,
 round(avg(relevant), 6) as avg_relevant, sum(relevant)::bigint as total_relevant from p join u using (query_type) group by 1""")
def dataset_statistics(spark, d):
    """Query-relevance pairs: a label's vectors are the relevant documents of the query 'label'."""
    qrels = load(spark, d, "embeddings").select(
        F.col("label").alias("query"), F.col("vec_id").alias("doc_id"), F.when(F.col("label") < 5, "specific").otherwise("general").alias("query_type"),
        F.when(F.col("label") % 3 == 0, "easy").when(F.col("label") % 3 == 1, "medium").otherwise("hard").alias("difficulty"),
    )
    return aggregates.dataset_statistics(qrels)


@query("dataset_merge_split", "SO4 SO6 Z14", """
with u as (select 'b' || item_id k from benchmark union all select 'd' || doc_id from documents)
select case when cast(('0x' || substr(md5('42:' || k), 1, 7)) as bigint) / 268435456 < 0.8 then 'train' else 'test' end as part, count(*) as n from u group by 1""")
def dataset_merge_split(spark, d):
    """Union of two query sets with a seeded hash split into train and test."""
    a = load(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("pair_id"), F.col("text").alias("query"))
    b = load(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("pair_id"), F.col("text").alias("query"))
    return aggregates.hash_split(a.unionByName(b), "pair_id", train=0.8, seed=42).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("ema_latency", "AGG19 F10", f"""
with recursive {X.REQUESTS_SQL}, o as (select endpoint, response_time, row_number() over (partition by endpoint order by ts, event_id) i from requests),
r as (select endpoint, i, response_time ema from o where i = 1 union all select r.endpoint, o.i, 0.1 * o.response_time + 0.9 * r.ema from r join o on o.endpoint = r.endpoint and o.i = r.i + 1)
select endpoint, round(arg_max(ema, i), 6) as ema, max(i) as samples from r group by 1""")
def ema_latency(spark, d):
    from folioscan.operators.ranks import moving_average

    r = X.requests(spark, d)
    out = moving_average(r, ["endpoint"], "response_time", F.date_trunc("hour", "ts"), [F.desc("ts"), F.desc("event_id")])
    return out.select("endpoint", F.round("ema", 6).alias("ema"), "samples")


@query("issue_examples", "AGG28", f"""
with {X.STATE_SQL}, i as (select coalesce(processing_version, 'null') issue, doc_id, row_number() over (partition by processing_version order by doc_id) rn from doc_state)
select issue, count(*) as n, string_agg(cast(doc_id as varchar), ',' order by doc_id) filter (rn <= 5) as examples from i group by 1""")
def issue_examples(spark, d):
    docs = X.document_state(spark, d).select(F.coalesce("processing_version", F.lit("null")).alias("issue"), "doc_id")
    return aggregates.counted_examples(docs, "issue", "doc_id", 5)
