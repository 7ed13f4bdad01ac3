"""Registered queries: joins over documents, chunks and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import ids
from folioscan.operators import ingest, similarity
from folioscan.plans import fixtures as X
from folioscan.plans import sqltext as S
from folioscan.plans.registry import query
from folioscan.session import load, load_spread


@query("docs_without_chunks", "J4", """
select doc_id, source from documents where doc_id not in (select vec_id from embeddings)""")
def docs_without_chunks(spark, d):
    vec = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return load(spark, d, "documents").join(vec, "doc_id", "left_anti").select("doc_id", "source")


@query("orphan_chunks", "J5 LN6", f"""
with {X.CHUNKS_SQL}, {X.V2_SQL} select document_id, count(*) as orphaned_chunks from chunks where document_id not in (select doc_id from documents_v2) group by 1""")
def orphan_chunks(spark, d):
    live = X.documents_v2(spark, d).select(F.col("doc_id").alias("document_id"))
    return X.chunks(spark, d).join(live, "document_id", "left_anti").groupBy("document_id").agg(F.count(F.lit(1)).alias("orphaned_chunks"))


@query("docs_with_outdated_chunks", "J6 PF8", f"""
with {X.CHUNKS_SQL} select doc_id, source from documents where doc_id in (select document_id from chunks where embedding_model is distinct from 'all-MiniLM-L6-v2')""")
def docs_with_outdated_chunks(spark, d):
    old = X.chunks(spark, d).filter(~F.col("embedding_model").eqNullSafe("all-MiniLM-L6-v2")).select(F.col("document_id").alias("doc_id"))
    return load(spark, d, "documents").join(old, "doc_id", "left_semi").select("doc_id", "source")


@query("newer_chunk_theta", "J7", f"""
with {X.CHUNKS_SQL}, {X.STATE_SQL} select doc_id, count(*) as newer_chunks from doc_state join chunks on document_id = doc_id and processing_timestamp > last_processed_at group by 1""")
def newer_chunk_theta(spark, d):
    docs, ch = X.document_state(spark, d), X.chunks(spark, d)
    newer = docs.join(ch, (ch.document_id == docs.doc_id) & (ch.processing_timestamp > docs.last_processed_at))
    return newer.groupBy("doc_id").agg(F.count(F.lit(1)).alias("newer_chunks"))


@query("migrate_vectors", "J8 SNK10", """
with m as (select doc_id old_id, substr(sha256('doc/' || doc_id), 1, 16) new_id from documents where lang <> 'de'),
s as (select e.*, m.new_id from embeddings e left join m on old_id = vec_id)
select label, count(*) as source_rows, count(new_id) as migrated, count(*) - count(new_id) as skipped,
 count(case when new_id is not null and len(embedding) <> 64 then 1 end) as wrong_dims from s group by 1""")
def migrate_vectors(spark, d):
    vec = load(spark, d, "embeddings")
    docs = load(spark, d, "documents").filter("lang <> 'de'")
    id_map = docs.select(F.col("doc_id").alias("old_id"), ids.url_id(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).alias("new_id"))
    moved = ingest.migrate_rows(vec, id_map, "vec_id", 64, "embedding").groupBy("label").agg(
        F.count(F.lit(1)).alias("migrated"), F.count_if(F.col("embedding").isNull()).alias("wrong_dims")
    )
    total = vec.groupBy("label").agg(F.count(F.lit(1)).alias("source_rows"))
    m = F.coalesce("migrated", F.lit(0))
    return total.join(moved, "label", "left").select(
        "label", "source_rows", m.alias("migrated"), (F.col("source_rows") - m).alias("skipped"), F.coalesce("wrong_dims", F.lit(0)).alias("wrong_dims")
    )


@query("version_diff_full_outer", "J9 SO2 SO3 AGG23", f"""
with {X.V2_SQL} select coalesce(n.lang, o.lang) as lang, sum(case when o.doc_id is null then 1 else 0 end)::bigint as added,
 sum(case when n.doc_id is null then 1 else 0 end)::bigint as deleted, sum(case when o.text <> n.text then 1 else 0 end)::bigint as modified,
 sum(case when o.text = n.text then 1 else 0 end)::bigint as unchanged
from documents o full join documents_v2 n using (doc_id) group by 1""")
def version_diff_full_outer(spark, d):
    old = load(spark, d, "documents").select("doc_id", F.col("lang").alias("old_lang"), ids.content_hash(F.col("text")).alias("old_hash"))
    new = X.documents_v2(spark, d).select("doc_id", F.col("lang").alias("new_lang"), ids.content_hash(F.col("text")).alias("new_hash"))
    both = old.join(new, "doc_id", "full")
    return both.groupBy(F.coalesce("new_lang", "old_lang").alias("lang")).agg(
        F.count_if(F.col("old_hash").isNull()).alias("added"),
        F.count_if(F.col("new_hash").isNull()).alias("deleted"),
        F.count_if(F.col("old_hash") != F.col("new_hash")).alias("modified"),
        F.count_if(F.col("old_hash") == F.col("new_hash")).alias("unchanged"),
    )


@query("keyword_overlap_topk", "J12 E17 T6", f"""
with q as (select item_id query_id, unnest(list_distinct({S.words('lower(text)')})) w from benchmark),
t as (select doc_id, unnest(list_distinct({S.words('lower(text)')})) w from documents),
c as (select query_id, doc_id, count(*) overlap from q join t using (w) group by 1, 2)
select query_id, doc_id, overlap, row_number() over (partition by query_id order by overlap desc, doc_id) as rank from c qualify rank <= 5""")
def keyword_overlap_topk(spark, d):
    q = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return similarity.keyword_overlap(q, load_spread(spark, d, "documents", "doc_id"), 5).select("query_id", "doc_id", "overlap", "rank")


@query("jaccard_join", "J14 ST9", f"""
with s as (select doc_id, list_sort(list_distinct({S.words('lower(text)')})) w from documents),
g as (select min(doc_id) a, count(*) members, any_value(w) w from s where len(w) > 0 group by array_to_string(w, ' '))
select x.a as a, y.a as b, x.members as members_a, y.members as members_b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)), 6) as similarity
from g x join g y on x.a < y.a and len(x.w) >= 0.9 * len(y.w) and len(y.w) >= 0.9 * len(x.w)
where len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) > 0.9""")
def jaccard_join(spark, d):
    """Similar documents; copies are folded into one representative with its number of members."""
    found = similarity.similar_texts(load_spread(spark, d, "documents", "doc_id"), "doc_id", "text", 0.9)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("doc_info_scalar_subquery", "J18 R14 Z1", f"""
with {X.CHUNKS_SQL} select doc_id, source, sha256(text) as hash, (select count(*) from chunks where document_id = doc_id) as chunk_count from documents""")
def doc_info_scalar_subquery(spark, d):
    ch = X.chunks(spark, d)
    counted = ch.where(F.col("document_id") == F.col("this_doc").outer()).select(F.count(F.lit(1)))
    docs = load(spark, d, "documents").withColumnRenamed("doc_id", "this_doc")
    return docs.select(F.col("this_doc").alias("doc_id"), "source", ids.content_hash(F.col("text")).alias("hash"), counted.scalar().alias("chunk_count"))


@query("labelled_semi", "J6 J19 SNK6", """
select source, count(*) as removed, max(doc_id) as last_removed from documents where doc_id in (select doc_id from labels where toxic = 1) group by 1""")
def labelled_semi(spark, d):
    toxic = load(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return load(spark, d, "documents").join(toxic, "doc_id", "left_semi").groupBy("source").agg(
        F.count(F.lit(1)).alias("removed"), F.max("doc_id").alias("last_removed")
    )
