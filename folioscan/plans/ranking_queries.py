"""Registered queries: learning to rank from click feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import fusion
from folioscan.plans import fixtures as X
from folioscan.plans import sqltext as S
from folioscan.plans.registry import query
from folioscan.plans.retrieval_queries import BENCH, DOCS, bench_queries, lexical_hits
from folioscan.session import as_of, load, sent_small

_FEATURES = f"""{S.bm25(BENCH, DOCS)}, {S.ranked('bm', 'score', 10, 'top')}, {X.CLICKS_SQL},
hist as (select chunk_id, least(count(*) / 100.0, 1.0) click_rate, avg(dwell_time) dwell from clicks where ts >= (select max(ts) from events) - interval 30 day group by 1),
feat as (select t.query_id, t.doc_id, 1.0 / (60 + t.rk) original_score, length(b.text) query_length, len({S.words('b.text')}) query_terms, length(d.text) doc_length,
  contains(lower(d.source), lower(b.text))::int title_match, contains(lower(string_split(d.text, chr(10))[1]), lower(b.text))::int heading_match,
  t.score bm25_score, 0.0 semantic_similarity, 1.0 / (60 + t.rk) rrf_score, t.rk - 1 original_rank, coalesce(click_rate, 0) click_rate, coalesce(dwell, 0) avg_dwell_time
  from top t join benchmark b on item_id = query_id join documents d using (doc_id) left join hist on chunk_id = doc_id)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text", F.col("source").alias("title"), F.get(F.split("text", "\n"), F.lit(0)).alias("heading"))
    hits = sent_small(lexical_hits(spark, d, 10).select("query_id", "doc_id", F.col("score").alias("bm25_score"), "rank"))
    rrf = F.lit(1.0) / (F.col("rank") + 60)
    results = docs.join(hits, "doc_id").join(bench_queries(spark, d), "query_id").withColumns(
        {"rrf_score": rrf, "original_score": rrf, "semantic_similarity": F.lit(0.0)}
    )
    since = as_of(load(spark, d, "events")) - F.make_interval(days=F.lit(30))
    clicks = X.clicks(spark, d).join(hits.withColumnRenamed("doc_id", "chunk_id"), "chunk_id", "left_semi")
    return fusion.ranking_features(results, fusion.click_features(clicks, since))


@query("ltr_features", "L1 J11 ST8", f"""
with {_FEATURES} select query_id, doc_id, query_length, query_terms, doc_length, title_match, heading_match, bm25_score, round(rrf_score, 8) as rrf_score,
 original_rank, round(click_rate, 6) as click_rate, round(avg_dwell_time, 6) as avg_dwell_time from feat""")
def ltr_features(spark, d):
    return features(spark, d).select(
        "query_id", "doc_id", "query_length", "query_terms", "doc_length", "title_match", "heading_match", "bm25_score",
        F.round("rrf_score", 8).alias("rrf_score"), "original_rank", F.round("click_rate", 6).alias("click_rate"), F.round("avg_dwell_time", 6).alias("avg_dwell_time"),
    )


@query("ltr_rerank", "L2 L3 M4 W3", f"""
with {_FEATURES}, s as (select *, round(0.7 * original_score + 0.3 * (0.1 * query_length + 0.2 * query_terms + 0.05 * doc_length + 0.3 * title_match + 0.2 * heading_match
  + 0.4 * bm25_score + 0.5 * semantic_similarity + 0.6 * rrf_score - 0.1 * original_rank + 0.8 * click_rate + 0.3 * avg_dwell_time), 4) score from feat)
select query_id, doc_id, score, original_rank, row_number() over (partition by query_id order by score desc, doc_id) as new_rank from s""")
def ltr_rerank(spark, d):
    return fusion.rerank(features(spark, d), digits=4).select("query_id", "doc_id", "score", "original_rank", "new_rank")


_UPDATE = f"""{X.CLICKS_SQL}, rc as (select * from clicks where ts >= (select max(ts) from events) - interval 7 day order by ts desc, event_id limit 1000),
st as (select count(*) n, avg(position) mp from rc),
wt as (select n, mp, 0.8 * case when mp < 3 then 1.01 else 0.99 end w9, 0.3 * case when mp < 3 then 1.01 else 1.0 end w10 from st),
nm as (select *, sqrt(0.01 + 0.04 + 0.0025 + 0.09 + 0.04 + 0.16 + 0.25 + 0.36 + 0.01 + w9 * w9 + w10 * w10) l from wt)"""


@query("ltr_weight_update", "L4 M3 T5", f"""
with {_UPDATE} select n, round(mp, 6) as mean_position, round(case when n >= 10 then 0.1 / l else 0.1 end, 6) as w_query_length,
 round(case when n >= 10 then w9 / l else 0.8 end, 6) as w_click_rate, round(case when n >= 10 then w10 / l else 0.3 end, 6) as w_avg_dwell_time from nm""")
def ltr_weight_update(spark, d):
    since = as_of(load(spark, d, "events")) - F.make_interval(days=F.lit(7))
    w = fusion.updated_weights(X.clicks(spark, d), since)
    return w.select("n", *[F.round(c, 6).alias(c) for c in ("mean_position", "w_query_length", "w_click_rate", "w_avg_dwell_time")])


@query("ltr_model_stats", "L5 AGG2", f"""
with {_UPDATE}, a as (select count(*) c, count(distinct query) q from clicks)
select c as total_clicks, q as unique_queries, unnest(['click_rate', 'avg_dwell_time', 'rrf_score']) as feature,
 unnest([round(w9 / l, 6), round(w10 / l, 6), round(0.6 / l, 6)]) as weight from nm cross join a""")
def ltr_model_stats(spark, d):
    clicks = X.clicks(spark, d)
    since = as_of(load(spark, d, "events")) - F.make_interval(days=F.lit(7))
    w = fusion.updated_weights(clicks, since)
    long = w.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f"w_{f}", 6).alias("weight")) for f in ("click_rate", "avg_dwell_time", "rrf_score")])))
    return long.select(
        clicks.agg(F.count(F.lit(1))).scalar().alias("total_clicks"), clicks.agg(F.countDistinct("query")).scalar().alias("unique_queries"), "feature", "weight"
    )
