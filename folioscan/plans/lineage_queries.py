"""Registered queries: processing lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import lineage
from folioscan.plans import fixtures as X
from folioscan.plans.registry import query
from folioscan.session import load

TARGET = ("v2.0", "all-MiniLM-L6-v2", "v1.0.0")
_FACTS = f"""{X.CHUNKS_SQL}, {X.STATE_SQL}, f as (select document_id doc_id, count(*) n, sum(case when embedding_model is distinct from 'all-MiniLM-L6-v2' then 1 else 0 end)::bigint om,
  sum(case when chunker_version is distinct from 'v1.0.0' then 1 else 0 end)::bigint oc from chunks group by 1)"""


@query("lineage_processing_summary", "LN1 AGG6 AGG7 AGG8", f"""
with {X.CHUNKS_SQL}, {X.STATE_SQL}
select 'processing_version' as kind, coalesce(processing_version, 'null') as version, count(*) as n from doc_state group by 2
union all select 'embedding_model', coalesce(embedding_model, 'null'), count(*) from chunks group by 2
union all select 'chunker_version', coalesce(chunker_version, 'null'), count(*) from chunks group by 2
union all select 'recent_documents', '24h', count(*) from doc_state where last_processed_at >= (select max(last_processed_at) from doc_state) - interval 24 hour
union all select 'recent_chunks', '24h', count(*) from chunks where processing_timestamp >= (select max(last_processed_at) from doc_state) - interval 24 hour""")
def lineage_processing_summary(spark, d):
    from folioscan.operators.aggregates import distributions

    docs, chunks = X.document_state(spark, d), X.chunks(spark, d)
    edge = docs.agg(F.max("last_processed_at") - F.make_interval(hours=F.lit(24))).scalar()
    versions = docs.groupBy(F.lit("processing_version").alias("kind"), F.coalesce("processing_version", F.lit("null")).alias("version")).agg(F.count(F.lit(1)).alias("n"))

    def recent(df, column, kind):
        return df.agg(F.count_if(F.col(column) >= edge).alias("n")).select(F.lit(kind).alias("kind"), F.lit("24h").alias("version"), "n")

    parts = [
        distributions(chunks, ["embedding_model", "chunker_version"]),
        recent(docs, "last_processed_at", "recent_documents"), recent(chunks, "processing_timestamp", "recent_chunks"),
    ]
    for p in parts:
        versions = versions.unionByName(p)
    return versions


@query("reprocessing_candidates", "LN2 SO5 J6", f"""
with {_FACTS} select doc_id, url, case when processing_version is distinct from 'v2.0' then 'outdated_processing_version' when coalesce(om, 0) > 0 then 'outdated_embedding_model' else 'outdated_chunker_version' end as reason,
 coalesce(n, 0) as total_chunks, coalesce(om, 0) as old_model_chunks, coalesce(oc, 0) as old_chunker_chunks from doc_state left join f using (doc_id)
where processing_version is distinct from 'v2.0' or om > 0 or oc > 0""")
def reprocessing_candidates(spark, d):
    c = lineage.reprocessing_candidates(X.document_state(spark, d), X.chunks(spark, d), *TARGET)
    return c.select("doc_id", "url", "reason", "total_chunks", "old_model_chunks", "old_chunker_chunks")


@query("reprocessing_candidates_limited", "LN2 SO5", f"""
with {_FACTS}, c as (select doc_id, case when processing_version is distinct from 'v2.0' then 1 when coalesce(om, 0) > 0 then 2 else 3 end priority from doc_state left join f using (doc_id)
where processing_version is distinct from 'v2.0' or om > 0 or oc > 0) select doc_id, priority::int as priority from c order by 2, 1 limit 50""")
def reprocessing_candidates_limited(spark, d):
    c = lineage.reprocessing_candidates(X.document_state(spark, d), X.chunks(spark, d), *TARGET, limit=50)
    return c.select("doc_id", "priority")


@query("lineage_reprocessing_stats", "LN3 AGG9", f"""
with {_FACTS}, s as (select count(*) t, sum((processing_version is distinct from 'v2.0')::int)::bigint a, sum((coalesce(om, 0) > 0)::int)::bigint b, sum((coalesce(oc, 0) > 0)::int)::bigint c,
  sum(n)::bigint tc, sum(om)::bigint x, sum(oc)::bigint y from doc_state left join f using (doc_id))
select t as total_documents, a as outdated_processing, b as outdated_embeddings, c as outdated_chunker, tc as total_chunks, x as chunks_outdated_embeddings, y as chunks_outdated_chunker,
 t - greatest(a, b, c) as documents_up_to_date, tc - greatest(x, y) as chunks_up_to_date from s""")
def lineage_reprocessing_stats(spark, d):
    return lineage.reprocessing_stats(X.document_state(spark, d), X.chunks(spark, d), *TARGET)


_ISSUES = f"""{X.CHUNKS_SQL}, {X.STATE_SQL}, big as (select * from chunks),
i as (select 'documents_without_chunks' issue, count(*) n from doc_state where doc_id not in (select document_id from big)
 union all select 'chunks_without_embeddings', count(*) from big where not has_embedding
 union all select 'chunks_missing_lineage', count(*) from big where embedding_model is null or chunker_version is null or processing_timestamp is null
 union all select 'inconsistent_timestamps', count(distinct doc_id) from doc_state join big on document_id = doc_id and processing_timestamp > last_processed_at)"""


def _issues(spark, d):
    chunks = X.chunks(spark, d)
    return lineage.consistency_issues(X.document_state(spark, d), chunks)


@query("lineage_audit", "LN4 J4 J7 AGG11", f"with {_ISSUES} select issue, n from i where n > 0")
def lineage_audit(spark, d):
    return _issues(spark, d)


@query("lineage_health", "LN4 AGG11 Z28", f"with {_ISSUES} select count(*) as issues_found, greatest(0, 100 - 10 * count(*)) as health_score from i where n > 0")
def lineage_health(spark, d):
    return lineage.health(_issues(spark, d))


@query("lineage_document", "LN5 AGG12 Z12", f"""
with {X.CHUNKS_SQL}, {X.STATE_SQL} select doc_id, any_value(url) as url, any_value(processing_version) as processing_version, count(chunk_id) as total_chunks,
 count(distinct embedding_model) as unique_embedding_models, count(distinct chunker_version) as unique_chunker_versions, coalesce(sum(length(content)), 0)::bigint as content_length
from doc_state left join chunks on document_id = doc_id group by doc_id""")
def lineage_document(spark, d):
    return lineage.document_summary(X.document_state(spark, d), X.chunks(spark, d))


@query("lineage_summary_view", "AGG10 F4", f"""
with {X.CHUNKS_SQL} select chunker_version, embedding_model, count(*) as chunk_count, count(distinct document_id) as document_count,
 strftime(min(processing_timestamp), '%Y-%m-%d %H:%M:%S') as first_processed, strftime(max(processing_timestamp), '%Y-%m-%d %H:%M:%S') as last_processed from chunks group by 1, 2""")
def lineage_summary_view(spark, d):
    v = lineage.lineage_view(X.chunks(spark, d))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return v.select("chunker_version", "embedding_model", "chunk_count", "document_count", shown("first_processed"), shown("last_processed"))


@query("lineage_backfill", "LN7 LN8 Z27 F1", f"""
with {X.CHUNKS_SQL}, b as (select *, coalesce(chunker_version, 'v1.0.0') cv, coalesce(embedding_model, 'all-MiniLM-L6-v2') em from chunks)
select chunk_id, cv as chunker_version, em as embedding_model, sha256(cv || '|' || em || '|' || document_id || '|' || chunk_index || '|unknown') as lineage_id from b""")
def lineage_backfill(spark, d):
    chunks = X.chunks(spark, d)
    if lineage.missing_columns(chunks, ["chunker_version", "embedding_model", "processing_timestamp"]):
        raise ValueError("lineage columns are missing")
    return lineage.backfill(chunks, "v1.0.0", "all-MiniLM-L6-v2").select("chunk_id", "chunker_version", "embedding_model", "lineage_id")


@query("audit_trail", "LN9 Z26", """
with s as (select event_id, ts, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) previous from events)
select event_id, user_id as entity, event_type as state, previous from s where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'""")
def audit_trail(spark, d):
    ev = load(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("entity"), F.col("event_type").alias("state"))
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return lineage.audit_trail(ev, t("2024-01-10 00:00:00"), t("2024-01-12 00:00:00")).select("event_id", "entity", "state", "previous")


@query("job_lifecycle", "Z26 SRC15", """
select user_id as job_id, arg_max(event_type, (ts, event_id)) as state, count(*) as transitions,
 round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) as seconds from events group by 1""")
def job_lifecycle(spark, d):
    """Last state and duration per job; a user's events stand for the job's state changes."""
    ev = load(spark, d, "events")
    secs = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return ev.groupBy(F.col("user_id").alias("job_id")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("transitions"), F.round(secs, 3).alias("seconds")
    )
