"""Registered queries: incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.ids import content_hash
from folioscan.operators import changes, nearest, sections
from folioscan.plans import fixtures as X
from folioscan.plans import sqltext as S
from folioscan.plans.registry import query
from folioscan.plans.retrieval_queries import centroid_queries, vector_chunks
from folioscan.session import as_of, load


@query("changed_documents", "I1 D1 I9", f"""
with {X.V2_SQL}, c as (select doc_id, text, substr(md5(case when lang = 'fr' then 'x' || source else source end), 1, 8) etag,
  case lang when 'de' then '2024-01-02 00:00:00' when 'es' then 'yesterday' else '2024-01-01 00:00:00' end lm from documents_v2),
o as (select doc_id, sha256(text) h, substr(md5(source), 1, 8) etag, timestamp '2024-01-01 00:00:00' lm from documents)
select c.doc_id, case when o.doc_id is null then 'new' when o.h <> sha256(c.text) then 'content' when c.etag <> o.etag then 'etag'
 when try_cast(c.lm as timestamp) > o.lm then 'modified' else 'unchanged' end as reason from c left join o using (doc_id)""")
def changed_documents(spark, d):
    lang, source = F.col("lang"), F.col("source")
    tag = lambda c: F.substring(F.md5(c), 1, 8)
    crawl = X.documents_v2(spark, d).select(
        "doc_id", "text", tag(F.when(lang == "fr", F.concat(F.lit("x"), source)).otherwise(source)).alias("etag"),
        F.when(lang == "de", "2024-01-02 00:00:00").when(lang == "es", "yesterday").otherwise("2024-01-01 00:00:00").alias("last_modified"),
    )
    stored = load(spark, d, "documents").select(
        "doc_id", content_hash(F.col("text")).alias("content_hash"), tag(source).alias("etag"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_modified"),
    )
    return changes.change_reason(crawl, stored, "doc_id")


@query("recrawl_needed", "I2 D2 PF7", """
with m as (select max(ts) t from events), s as (select doc_id page_id, case when toxic = 1 then null when quality = 1 then t - interval 12 hour else t - interval 48 hour end lc from labels, m)
select p.page_id, s.page_id is null or coalesce(lc < (select t from m) - interval 24 hour, false) as due from pages p left join s using (page_id)""")
def recrawl_needed(spark, d):
    moment = as_of(load(spark, d, "events"))
    ago = lambda h: moment - F.make_interval(hours=F.lit(h))
    stored = load(spark, d, "labels").select(
        F.col("doc_id").alias("page_id"),
        F.when(F.col("toxic") == 1, None).when(F.col("quality") == 1, ago(12)).otherwise(ago(48)).alias("last_crawled"),
    )
    return changes.recrawl_needed(load(spark, d, "pages").select("page_id"), stored, moment).select("page_id", "due")


@query("needs_reprocessing", "I3 PF8", f"""
with {X.CHUNKS_SQL}, {X.STATE_SQL}, f as (select document_id doc_id, bool_or(embedding_model is distinct from 'all-MiniLM-L6-v2' or chunker_version is distinct from 'v1.0.0') old from chunks group by 1)
select doc_id, last_processed_at is null or processing_version is distinct from 'v2.0' or coalesce(old, false) as needed from doc_state left join f using (doc_id)""")
def needs_reprocessing(spark, d):
    return changes.needs_reprocessing(X.document_state(spark, d), X.chunks(spark, d), "v2.0", "all-MiniLM-L6-v2", "v1.0.0")


@query("hash_gated_index", "SNK3 S6 H1", f"""
with {X.V2_SQL} select n.doc_id, n.source, sha256(n.text) as content_hash from documents_v2 n left join documents o using (doc_id) where o.doc_id is null or sha256(o.text) <> sha256(n.text)""")
def hash_gated_index(spark, d):
    stored = load(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return changes.hash_gate(X.documents_v2(spark, d), stored, "doc_id").select("doc_id", "source", "content_hash")


@query("latest_wins_upsert", "SNK1 SNK2 W9 I4", f"""
with {X.V2_SQL}, u as (select doc_id, text, source, 1 v from documents union all select doc_id, text, source, 2 from documents_v2)
select doc_id, source, v::int as version, length(text) as size from u qualify row_number() over (partition by doc_id order by v desc) = 1""")
def latest_wins_upsert(spark, d):
    old = load(spark, d, "documents").select("doc_id", "text", "source", F.lit(1).alias("version"))
    new = X.documents_v2(spark, d).select("doc_id", "text", "source", F.lit(2).alias("version"))
    return changes.upsert(old, new, "doc_id", "version").select("doc_id", "source", "version", F.length("text").cast("long").alias("size"))


@query("delete_by_source", "SNK6 J19 J5", f"""
with {X.CHUNKS_SQL}, gone as (select doc_id from documents where source = 'src3')
select (select count(*) from chunks where document_id in (select doc_id from gone)) as removed_chunks, (select count(*) from gone) as removed_documents,
 (select count(*) from chunks where document_id not in (select doc_id from gone)) as kept_chunks""")
def delete_by_source(spark, d):
    docs = load(spark, d, "documents")
    gone = docs.filter("source = 'src3'").select(F.col("doc_id").alias("document_id"))
    kept, removed = changes.delete_where_in(X.chunks(spark, d), gone, "document_id")
    one = lambda df, c: df.agg(c).scalar()
    return removed.select(
        F.col("removed").alias("removed_chunks"), one(gone, F.count(F.lit(1))).alias("removed_documents"), one(kept, F.count(F.lit(1))).alias("kept_chunks")
    )


def _markdown_v2(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(
        F.lit("Imported from "), "source", F.lit("\n\n# Document "), F.col("doc_id").cast("string"), F.lit("\n\n## "),
        F.upper("lang"), F.lit(" text\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n### Size\n\n"),
        F.length("text").cast("string"), F.lit(" characters\n"),
    )
    return X.documents_v2(spark, d).select("doc_id", body.alias("body"))


def _section_diff(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    old = sections.body_sections(X.markdown_docs(spark, d), "doc_id", url, "body")
    new = sections.body_sections(_markdown_v2(spark, d), "doc_id", url, "body")
    return changes.section_changes(old, new, "doc_id")


_ID = lambda h, raw: f"substr(sha256('doc/' || doc_id || '#' || {h} || '#' || substring({raw}, 1, 100)), 1, 16)"


def _sections_sql(table: str, size: str) -> str:
    """Root, body and size section of the rendered documents, written down directly."""
    body = "chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10)"
    parts = [
        ("'Document Root'", "'Imported from ' || source || chr(10) || chr(10)"),
        ("upper(lang) || ' text'", body),
        ("'Size'", f"chr(10) || {size} || ' characters' || chr(10) || chr(10)"),
    ]
    return " union all ".join(
        f"select doc_id, {_ID(h, raw)} id, sha256({raw}) hash, {raw} raw from {table} where {S.strip(raw)} <> ''" for h, raw in parts
    )


@query("section_diff", "I6 J9 SO2 SO3 Z5", f"""
with {X.V2_SQL}, o as ({_sections_sql('documents', 'n_chars')}), n as ({_sections_sql('documents_v2', 'length(text)')})
select doc_id, id as section_id, case when o.hash is null then 'added' when n.hash is null then 'deleted' when o.hash <> n.hash then 'modified' else 'unchanged' end as action
from o full join n using (doc_id, id)""")
def section_diff(spark, d):
    return _section_diff(spark, d).select("doc_id", "section_id", "action")


_PLAN_SQL = f"""{X.V2_SQL}, o as ({_sections_sql('documents', 'n_chars')}), n as ({_sections_sql('documents_v2', 'length(text)')}),
diff as (select doc_id, id, case when o.hash is null then 'added' when n.hash is null then 'deleted' when o.hash <> n.hash then 'modified' else 'unchanged' end as action,
  o.raw as old_raw, n.raw as new_raw from o full join n using (doc_id, id)),
-- A modified section has ' rev' behind all of the old text: one block.
alike as (select doc_id, id, 2.0::double * length({S.strip('old_raw')}) / (length({S.strip('old_raw')}) + length({S.strip('new_raw')})) as similarity from diff where action = 'modified'),
plan as (select doc_id, id as section_id, action, case action when 'unchanged' then 1.0 when 'modified' then coalesce(similarity, 1.0) else 0.0 end as similarity,
  action in ('added', 'deleted') or (action = 'modified' and coalesce(similarity, 1.0) < 0.8) as reprocess from diff left join alike using (doc_id, id))"""


@query("incremental_plan", "I7 I8 ST14 Z6", f"""
with {_PLAN_SQL} select doc_id, section_id, action, round(similarity::double, 6) as similarity, reprocess from plan where action <> 'unchanged'""")
def incremental_plan(spark, d):
    plan = changes.reprocess_plan(_section_diff(spark, d))
    return plan.filter("action <> 'unchanged'").select("doc_id", "section_id", "action", F.round("similarity", 6).alias("similarity"), "reprocess")


@query("diff_statistics", "I8 AGG23", f"""
with {_PLAN_SQL} select doc_id, count_if(action = 'added')::bigint as added, count_if(action = 'modified')::bigint as modified, count_if(action = 'deleted')::bigint as deleted,
 count_if(action = 'unchanged')::bigint as unchanged, round(count_if(reprocess) / greatest(count_if(action <> 'deleted'), 1) * 100, 6)::double as reprocess_pct from plan group by 1""")
def diff_statistics(spark, d):
    plan = changes.reprocess_plan(_section_diff(spark, d))
    return changes.diff_stats(plan, ["doc_id"])


@query("retention_cleanup", "LN10 Z18", f"""
with {X.CLICKS_SQL}, m as (select max(ts) t from events)
select (select count(*) from clicks, m where ts < t - interval 20 day) as deleted, (select count(*) from clicks, m where ts >= t - interval 20 day) as kept""")
def retention_cleanup(spark, d):
    kept, deleted = changes.retain(X.clicks(spark, d), "ts", as_of(load(spark, d, "events")), 20)
    return deleted.select("deleted", kept.agg(F.count(F.lit(1))).scalar().alias("kept"))


@query("result_stream", "SNK8 S7", f"""
with {S.CENTROIDS}, s as (select label::bigint query_id, vec_id doc_id, round(list_cosine_similarity(v, embedding::double[]), 6) similarity from cen cross join (select vec_id, embedding from embeddings)),
{S.ranked('s', 'similarity', 3, 'top')}, h as (select query_id, count(*) n from top group by 1)
select query_id, 0::bigint as seq, 'metadata' as event, '{{"n":' || n || '}}' as payload from h
union all select query_id, rk, 'result', '{{"index":' || rk || ',"id":' || doc_id || ',"similarity":' || similarity || '}}' from top
union all select query_id, n + 1, 'complete', '{{"total":' || n || '}}' from h""")
def result_stream(spark, d):
    return changes.event_stream_rows(nearest.top_k_similar(centroid_queries(spark, d), vector_chunks(spark, d), 3))
