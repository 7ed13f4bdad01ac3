"""Registered queries: retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import evaluation as E
from folioscan.operators import lexical, nearest
from folioscan.operators.ranks import order_statistics
from folioscan.plans import fixtures as X
from folioscan.plans import sqltext as S
from folioscan.plans.registry import query
from folioscan.plans.retrieval_queries import (
    BENCH, DOCS, SEM_SQL, bench_queries, centroid_queries, three_modes, vector_chunks,
)
from folioscan.session import cut_lineage, load, load_spread

KS = [1, 3, 5, 10]
# queries: one per label centroid; judgments: the label's vectors; a query fails when its best hit is weak
RES_SQL = f"""{S.CENTROIDS}, sc as (select label::bigint query_id, vec_id doc_id, round(list_cosine_similarity(v, embedding::double[]), 6) score
  from cen cross join (select vec_id, embedding from embeddings)),
{S.ranked('sc', 'score', 20, 'res')},
qrels as (select label::bigint query_id, vec_id doc_id from embeddings),
qs as (select query_id, max(score) >= 0.34 success from res group by 1),
rel as (select r.*, (case when q.doc_id is null then 0 else 1 end) rel from res r left join qrels q using (query_id, doc_id)),
nr as (select query_id, count(*) n_rel from qrels group by 1)"""


def runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    hits = nearest.top_k_similar(centroid_queries(spark, d), vector_chunks(spark, d), 20)
    results = hits.select("query_id", F.col("chunk_id").alias("doc_id"), F.col("similarity").alias("score"), "rank")
    qrels = load(spark, d, "embeddings").select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"))
    queries = results.groupBy("query_id").agg((F.max("score") >= 0.34).alias("success"))
    return results, qrels, queries


def _at(k: int) -> str:
    return f"""select query_id, count(*) filter (rk <= {k}) ret, sum(rel) filter (rk <= {k}) hit, max(n_rel) n_rel,
  sum(rel / log2(rk + 1)) filter (rk <= {k}) dcg from rel join nr using (query_id) join qs using (query_id) where success group by 1"""


@query("precision_recall_f1_at_k", "E1 E2 E3 J20", f"""
with {RES_SQL}, m as ({' union all '.join(f"select {k} k, avg(hit / ret) p, avg(hit / n_rel) r from ({_at(k)})" for k in KS)})
select k::int as k, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1 from m""")
def precision_recall_f1_at_k(spark, d):
    s = E.summary(E.per_query(*runs(spark, d), KS), KS)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"precision_at_{k}").alias("precision"), F.col(f"recall_at_{k}").alias("recall"), F.col(f"f1_at_{k}").alias("f1")) for k in KS])
    return s.select(F.inline(rows))


@query("map_score", "E4 W4 F10", f"""
with {RES_SQL}, run as (select *, sum(rel) over (partition by query_id order by rk) seen from rel),
ap as (select query_id, coalesce(sum(case when rel = 1 then seen / rk end), 0) / max(n_rel) ap from run join nr using (query_id) join qs using (query_id) where success group by 1)
select query_id, round(ap, 6) as average_precision, round(avg(ap) over (), 6) as map from ap""")
def map_score(spark, d):
    m = E.per_query(*runs(spark, d), KS)
    mean = m.agg(F.avg("ap")).scalar()
    return m.select("query_id", F.round("ap", 6).alias("average_precision"), F.round(mean, 6).alias("map"))


@query("ndcg_at_k", "E5 M7", f"""
with {RES_SQL}, m as ({' union all '.join(f"select {k} k, avg(dcg / (select sum(1 / log2(i + 1)) from range(1, {k + 1}) t(i) where i <= n_rel)) v from ({_at(k)})" for k in KS)})
select k::int as k, round(v, 6) as ndcg from m""")
def ndcg_at_k(spark, d):
    s = E.summary(E.per_query(*runs(spark, d), KS), KS)
    return s.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"ndcg_at_{k}").alias("ndcg")) for k in KS])))


@query("mrr", "E6", f"""
with {RES_SQL}, f as (select query_id, min(case when rel = 1 then rk end) first from rel join qs using (query_id) where success group by 1)
select round(avg(coalesce(1.0 / first, 0)), 6) as mrr, count(*) as queries from f""")
def mrr(spark, d):
    m = E.per_query(*runs(spark, d), KS)
    return m.agg(F.round(F.avg("rr"), 6).alias("mrr"), F.count(F.lit(1)).alias("queries"))


@query("query_success", "E7", f"""
with {RES_SQL} select round(avg(success::int), 6) as success_rate, round(1 - avg(success::int), 6) as error_rate from qs""")
def query_success(spark, d):
    return E.success_rates(runs(spark, d)[2])


@query("diversity_and_coverage", "E8 E9", f"""
with {RES_SQL}, k as (select doc_id from res join qs using (query_id) where success)
select round(count(distinct doc_id) / count(*), 6) as diversity, round(count(distinct doc_id) / (select count(*) from documents), 6) as coverage from k""")
def diversity_and_coverage(spark, d):
    results, _, queries = runs(spark, d)
    return E.spread(results, queries, load(spark, d, "documents"))


@query("result_consistency", "E10 J13", f"""
with {X.CLICKS_SQL}, s as (select distinct lower(trim(query)) query, session_id run, chunk_id doc_id from clicks),
z as (select query, run, count(*) n from s group by 1, 2),
p as (select a.query, a.run i, b.run j, a.n ni, b.n nj from z a join z b on a.query = b.query and a.run < b.run),
c as (select x.query, x.run i, y.run j, count(*) common from s x join s y on x.query = y.query and x.doc_id = y.doc_id and x.run < y.run group by 1, 2, 3),
v as (select query, avg(coalesce(common, 0) / (ni + nj - coalesce(common, 0))) as m from p left join c using (query, i, j) group by 1)
select round(case when (select count(distinct query) from s) > 1 then coalesce(avg(m), 1.0) else 1.0 end, 6) as consistency from v""")
def result_consistency(spark, d):
    """Clicked chunks of every session that issued the same query, as one number."""
    c = X.clicks(spark, d).select("query", F.col("session_id").alias("run"), F.col("chunk_id").alias("doc_id"), F.lit(True).alias("success"))
    return E.consistency(c).select(F.round("consistency", 6).alias("consistency"))


@query("response_time_metrics", "E11 AGG16", f"""
with {X.REQUESTS_SQL}, ok as (select * from requests where status_code < 400)
select endpoint, round(avg(response_time), 10) as avg_time, round(quantile_cont(response_time, 0.5), 10) as p50, round(quantile_cont(response_time, 0.95), 10) as p95,
 round(count(*) / sum(response_time), 10) as throughput from ok group by 1""")
def response_time_metrics(spark, d):
    ok = X.requests(spark, d).filter("status_code < 400")
    at = lambda q, up: (F.ceil if up else F.floor)((F.col("n") - 1) * q)
    qs = {"p50": 0.5, "p95": 0.95}
    targets = {f"{n}_{'hi' if up else 'lo'}": at(q, up) for n, q in qs.items() for up in (False, True)}
    stats = order_statistics(ok, ["endpoint"], "response_time", targets)
    base = ok.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.avg("response_time").alias("a"), F.sum("response_time").alias("s"))
    between = lambda n, q: F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * ((F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q))
    return base.join(stats, "endpoint").select(
        "endpoint", F.round("a", 10).alias("avg_time"), *[F.round(between(n, q), 10).alias(n) for n, q in qs.items()],
        F.round(F.col("n") / F.col("s"), 10).alias("throughput"),
    )


@query("coherence", "E12 M10", f"""
with {RES_SQL}, c as (select query_id, least(coalesce(var_samp(score), 0) * 4, 1.0) c from res join qs using (query_id) where success group by 1)
select round(coalesce(avg(c), 0.5), 6) as coherence from c""")
def coherence(spark, d):
    results, _, queries = runs(spark, d)
    return E.coherence(results.join(queries.filter("success"), "query_id", "left_semi"))


def planted_qrels(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain a benchmark text; candidates hold all of its terms, the text decides."""
    q, docs = bench_queries(spark, d), load_spread(spark, d, "documents", "doc_id").select("doc_id", "text")
    candidates = lexical.with_all_terms(q, lexical.tokenised(docs, "doc_id", F.col("text"))).select("query_id", "doc_id")
    both = candidates.join(q, "query_id").join(docs, "doc_id")
    # a handful of judgments, used by several metrics
    return cut_lineage(both.filter(F.contains("text", "query_text")).select("query_id", "doc_id"))


MODES_SQL = f"""{S.bm25(BENCH, DOCS)}, {S.ranked('bm', 'score', 30, 'lex')}, {SEM_SQL}, {S.ranked('sim', 'similarity', 30, 'sem', 'similarity >= 0.3')},
hf as (select query_id, doc_id, l.rk lr, s.rk sr, coalesce(1.0 / (60 + l.rk), 0) + coalesce(1.0 / (60 + s.rk), 0) sc from lex l full join sem s using (query_id, doc_id)),
hy as (select *, row_number() over (partition by query_id order by round(sc, 12) desc, sr nulls last, doc_id) rk from hf),
mr as (select 'fulltext' as mode, query_id, doc_id, rk from lex where rk <= 10 union all select 'semantic', query_id, doc_id, rk from sem where rk <= 10
  union all select 'hybrid', query_id, doc_id, rk from hy where rk <= 10),
planted as (select item_id query_id, doc_id from benchmark b join documents d on contains(d.text, b.text)),
nrel as (select query_id, count(*) n_rel from planted group by 1),
base as (select mode, item_id query_id, coalesce(n_rel, 0) n_rel from (select distinct mode from mr) cross join benchmark left join nrel on query_id = item_id),
hits as (select m.mode, m.query_id, count(*) filter (rk <= 5) ret, sum(case when p.doc_id is not null and rk <= 5 then 1 else 0 end) hit,
  sum(case when p.doc_id is not null and rk <= 5 then 1 / log2(rk + 1) else 0 end) dcg from mr m left join planted p using (query_id, doc_id) group by 1, 2),
pq as (select mode, query_id, case when coalesce(ret, 0) = 0 then 0 else hit / ret end p, case when n_rel = 0 then 1 else coalesce(hit, 0) / n_rel end r,
  case when n_rel = 0 then 1 else coalesce(dcg, 0) / (select sum(1 / log2(i + 1)) from range(1, 6) t(i) where i <= n_rel) end nd from base left join hits using (mode, query_id)),
sm as (select mode, avg(p) p, avg(r) r, avg(nd) nd from pq group by 1),
mm as (select mode, round(p, 6) p, round(r, 6) r, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) f1, round(nd, 6) nd from sm)"""


def mode_metrics(spark: SparkSession, d: str) -> DataFrame:
    queries = bench_queries(spark, d).withColumn("success", F.lit(True))
    per = E.per_query(three_modes(spark, d), planted_qrels(spark, d), queries, [5], modes=["fulltext", "semantic", "hybrid"])
    return E.summary(per, [5], ["mode"])


@query("mode_comparison", "E18 AGG27 J21 R15 Z13", f"""
with {MODES_SQL} select mode, p as precision_at_5, r as recall_at_5, f1 as f1_at_5, nd as ndcg_at_5 from mm""")
def mode_comparison(spark, d):
    return mode_metrics(spark, d).select("mode", "precision_at_5", "recall_at_5", "f1_at_5", "ndcg_at_5")


@query("best_mode", "AGG27 E16", f"""
with {MODES_SQL} select arg_max(mode, (f1, mode)) as best_mode, max(f1) as best_f1,
 case when max(f1) filter (mode = 'hybrid') > greatest(max(f1) filter (mode = 'semantic'), max(f1) filter (mode = 'fulltext')) then 'hybrid recommended'
  when max(f1) filter (mode = 'semantic') > max(f1) filter (mode = 'fulltext') then 'semantic preferred' else 'fulltext preferred' end as advice from mm""")
def best_mode(spark, d):
    return E.recommendation(mode_metrics(spark, d).select("mode", F.col("f1_at_5").alias("f1")))


# one evaluated "mode" per endpoint: latency and success from the request log, F1 from its click rate
_ALERT_BASE = f"""{X.REQUESTS_SQL}, em as (select endpoint mode, avg(response_time) * 1000 avg_ms, avg((status_code < 400)::int) success_rate,
  round(avg(case when response_time < 0.01 then 1.0 else 0.0 end), 6) f1 from requests group by 1)"""


def endpoint_modes(spark: SparkSession, d: str) -> DataFrame:
    return X.requests(spark, d).groupBy(F.col("endpoint").alias("mode")).agg(
        (F.avg("response_time") * 1000).alias("avg_ms"), F.avg((F.col("status_code") < 400).cast("int")).alias("success_rate"),
        F.round(F.avg(F.when(F.col("response_time") < 0.01, 1.0).otherwise(0.0)), 6).alias("f1"),
    )


@query("quality_alerts", "E15", f"""
with {_ALERT_BASE}, a as (select mode, 'performance' as type, 'medium' as severity, avg_ms as value, 30.0 as threshold from em where avg_ms > 30
 union all select mode, 'reliability', 'high', success_rate, 0.95 from em where success_rate < 0.95
 union all select mode, 'quality', 'medium', f1, 0.2 from em where f1 < 0.2)
select mode, type, severity, round(value, 6) as value, threshold::double as threshold from a""")
def quality_alerts(spark, d):
    return E.alerts(endpoint_modes(spark, d), 30.0, 0.95, 0.2).withColumn("value", F.round("value", 6))


@query("baseline_vs_candidate", "E14 M9 J21", f"""
with {X.REQUESTS_SQL}, m as (select endpoint, avg(response_time) filter (ts < timestamp '2024-01-16') b, avg(response_time) filter (ts >= timestamp '2024-01-16') c from requests group by 1)
select endpoint, round((c - b) / b * 100, 10) as improvement_pct, round(greatest(0.001, 1 - abs(c - b) / greatest(b, 0.001)), 10) as heuristic_p from m""")
def baseline_vs_candidate(spark, d):
    mid = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    r, t = X.requests(spark, d), F.col("response_time")
    m = r.groupBy("endpoint").agg(F.avg(F.when(F.col("ts") < mid, t)).alias("b"), F.avg(F.when(F.col("ts") >= mid, t)).alias("c"))
    b, c = F.col("b"), F.col("c")
    return m.select(
        "endpoint", F.round(E.relative_improvement(b, c), 10).alias("improvement_pct"), F.round(E.heuristic_p_value(b, c), 10).alias("heuristic_p")
    )


@query("metric_history", "E19", f"""
with {X.REQUESTS_SQL}, h as (select endpoint, strftime(ts, '%Y-%m-%d') run, round(avg(response_time), 10) v from requests group by 1, 2),
l as (select *, lag(v) over (partition by endpoint order by run) previous from h)
select endpoint, run, v as value, previous from l where previous - v > 0.005""")
def metric_history(spark, d):
    """Daily metric snapshots that fell by more than 5 ms against the day before."""
    h = X.requests(spark, d).groupBy("endpoint", F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(F.round(F.avg("response_time"), 10).alias("value"))
    return E.regressions(h, ["endpoint"], "value", 0.005).select("endpoint", "run", "value", "previous")
