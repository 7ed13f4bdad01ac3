"""Registered queries: lexical, vector and hybrid retrieval over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.stems import stem_vocabulary as stem_terms
from folioscan.functions.vectors import cosine, cosine_distance, embedder
from folioscan.functions.text import tokens
from folioscan.operators import fusion, lexical, nearest, proximity, vector_index
from folioscan.plans import sqltext as S
from folioscan.plans.registry import query
from folioscan.session import cut_lineage, load, load_spread, sent_small

BENCH = "select item_id query_id, text txt from benchmark"
DOCS = "select doc_id, text txt from documents"


def bench_queries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def lexical_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs = lexical.tokenised(load_spread(spark, d, "documents", "doc_id"), "doc_id", F.col("text"))
    return lexical.top_k(bench_queries(spark, d), docs, k)


def semantic_hits(spark: SparkSession, d: str, k: int, floor: float | None = 0.3) -> DataFrame:
    embed = embedder("hashing-64")
    q = bench_queries(spark, d).select("query_id", embed(F.col("query_text")).alias("vector"))
    c = load_spread(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("chunk_id"), embed(F.col("text")).alias("vector"))
    return nearest.top_k_similar(q, c, k, floor).withColumnRenamed("chunk_id", "doc_id")


def centroid_queries(spark: SparkSession, d: str) -> DataFrame:
    """One query per label: the mean vector of the label's chunks; the label's chunks are relevant to it."""
    mean = nearest.centroids(load(spark, d, "embeddings"), "label")
    return mean.select(F.col("label").cast("long").alias("query_id"), "vector")


def vector_chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


SEM_SQL = f"""{S.embed(BENCH, 'query_id', 'qe')}, {S.embed(DOCS, 'doc_id', 'de')},
sim as (select query_id, doc_id, round(sum(a.w * b.w), 6) similarity from qe a join de b using (dim) group by 1, 2)"""


@query("bm25_topk", "R1 J2 T1 T3 T6 W1 F3", f"""
with {S.bm25(BENCH, DOCS)}, {S.ranked('bm', 'score', 10, 'top')}
select query_id, doc_id, score, rk as rank from top""")
def bm25_topk(spark, d):
    return lexical_hits(spark, d, 10).select("query_id", "doc_id", "score", "rank")


@query("bm25_bounded_topk", "R1 T1 T6", f"""
with {S.bm25(BENCH, DOCS)}, {S.ranked('bm', 'score', 10, 'top')}
select query_id, doc_id, score, rk as rank from top""")
def bm25_bounded_topk(spark, d):
    """The same rows as bm25_topk; documents whose weights can't reach the tenth score aren't scored."""
    docs = lexical.tokenised(load_spread(spark, d, "documents", "doc_id"), "doc_id", F.col("text"))
    return lexical.bounded_top_k(bench_queries(spark, d), docs, 10)[0].select("query_id", "doc_id", "score", "rank")


@query("bm25_all_terms", "R1 J2 ST12", f"""
with {S.bm25(BENCH, DOCS, join='all')}, {S.ranked('bm', 'score', 10, 'top')}
select query_id, doc_id, matched, score, rk as rank from top""")
def bm25_all_terms(spark, d):
    docs = lexical.tokenised(load_spread(spark, d, "documents", "doc_id"), "doc_id", F.col("text"))
    hits = lexical.bm25(bench_queries(spark, d), docs, match="all")
    return lexical.rank_top_k(hits, 10).select("query_id", "doc_id", "matched", "score", "rank")


_SITE = "select source || ' ' || lang query_id, source || ' ' || lang txt from documents group by 1, 2"


@query("bm25_weighted_fields", "R3", f"""
with {S.bm25(_SITE, "select doc_id, source || '/' || lang || '/' || doc_id txt from documents", 'pa')},
{S.bm25(_SITE, DOCS, 'bo')},
mix as (select query_id, doc_id, round(sum(part), 6) score from (
  select query_id, doc_id, score * 3.0 part from pa union all select query_id, doc_id, score * 1.0 from bo) group by 1, 2),
{S.ranked('mix', 'score', 5, 'top')}
select query_id, doc_id, score, rk as rank from top""")
def bm25_weighted_fields(spark, d):
    docs = load_spread(spark, d, "documents", "doc_id")
    q = docs.select(F.concat_ws(" ", "source", "lang").alias("query_id")).distinct().withColumn("query_text", F.col("query_id"))
    path = lexical.tokenised(docs, "doc_id", F.concat_ws("/", "source", "lang", "doc_id"))
    body = lexical.tokenised(docs, "doc_id", F.col("text"))
    mixed = lexical.weighted_fields(q, [(path, 3.0), (body, 1.0)])
    return lexical.rank_top_k(mixed, 5).select("query_id", "doc_id", "score", "rank")


STOP = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "with"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@query("fts_conjunctive", "R2 ST12", f"""
with d as (select doc_id, {S.toks('text')} tk from documents),
p as (select doc_id, term, count(*) tf, any_value(dl) dl from (select doc_id, unnest(tk) term, len(tk) dl from d) group by 1, 2),
q as (select * from (select item_id query_id, unnest(list_distinct({S.toks('text')})) term from benchmark) where term not in ({_STOP_SQL})),
n as (select query_id, count(*) nt from q group by 1)
select query_id, doc_id, round(sum(tf / (1 + ln(dl))), 6) as score
from q join p using (term) join n using (query_id) group by query_id, doc_id, nt having count(*) = nt""")
def fts_conjunctive(spark, d):
    docs = lexical.tokenised(load_spread(spark, d, "documents", "doc_id"), "doc_id", F.col("text"))
    return lexical.conjunctive(bench_queries(spark, d), docs, STOP)


@query("like_fallback", "R4 PF4 PF2 T2", """
select doc_id, source, 1.0::double as score from documents
where contains(lower(text), 'license') or contains(lower(source), 'license') order by doc_id limit 20""")
def like_fallback(spark, d):
    hits = lexical.like_search(load(spark, d, "documents"), "license", ["text", "source"])
    return hits.select("doc_id", "source", "score").orderBy("doc_id").limit(20)


@query("search_snippets", "ST10 PF13", f"""
with w as (select doc_id, {S.words('text')} ws from documents where contains(lower(text), 'license')),
h as (select doc_id, ws, list_position(list_transform(ws, lambda x: lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) = 'license'), true) p from w),
s as (select doc_id, ws, p, greatest(1, least(p - 4, len(ws) - 7)) st from h where p > 0)
select doc_id, (case when st > 1 then '…' else '' end) || array_to_string(list_transform(ws[st:st+7],
  lambda x: case when lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) = 'license' then '<b>' || x || '</b>' else x end), ' ')
  || (case when st + 7 < len(ws) then '…' else '' end) as snippet from s""")
def search_snippets(spark, d):
    hits = lexical.like_search(load(spark, d, "documents"), "license", ["text"])
    return hits.select("doc_id", lexical.snippet(F.col("text"), "license").alias("snippet")).filter("snippet is not null")


@query("semantic_topk", "R5 J10 T1 T6 PF5 PF6 PF21 W2", f"""
with {S.CENTROIDS}, s as (select label::bigint query_id, vec_id doc_id,
  round(list_cosine_similarity(v, embedding::double[]), 6) similarity from cen cross join (select vec_id, embedding from embeddings)),
{S.ranked('s', 'similarity', 10, 'top', 'similarity >= 0.3')}
select query_id, doc_id as chunk_id, similarity, rk as rank from top""")
def semantic_topk(spark, d):
    return nearest.top_k_similar(centroid_queries(spark, d), vector_chunks(spark, d), 10, 0.3)


@query("semantic_threshold", "M1 M2 PF6 J1", f"""
with {S.CENTROIDS} select vec_id as chunk_id, label, lang, round(list_cosine_similarity(v, embedding::double[]), 6) as similarity,
 round(1 - list_cosine_similarity(v, embedding::double[]), 6) as distance
from embeddings join cen using (label) join documents on doc_id = vec_id
where round(list_cosine_similarity(v, embedding::double[]), 6) >= 0.3""")
def semantic_threshold(spark, d):
    vec = load(spark, d, "embeddings")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    scored = vec.join(nearest.centroids(vec, "label"), "label").select(
        F.col("vec_id").alias("chunk_id"), "label",
        F.round(cosine(F.col("vector"), F.col("embedding")), 6).alias("similarity"),
        F.round(cosine_distance(F.col("vector"), F.col("embedding")), 6).alias("distance"),
    )
    return scored.filter("similarity >= 0.3").join(docs, "chunk_id").select("chunk_id", "label", "lang", "similarity", "distance")


@query("embed_missing", "R10 SNK4 PF19 F8", f"""
with {S.embed("select doc_id, text txt from documents where doc_id not in (select vec_id from embeddings)", 'doc_id', 'e')}
select doc_id, count(*) as used_dims, round(sum(dim * w), 4) as checksum from e where w <> 0 group by 1""")
def embed_missing(spark, d):
    known = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    todo = load_spread(spark, d, "documents", "doc_id").join(known, "doc_id", "left_anti")
    v = todo.select("doc_id", embedder("hashing-64")(F.col("text")).alias("v"))
    used = F.size(F.filter("v", lambda x: x != 0))
    check = F.aggregate(
        F.zip_with(F.sequence(F.lit(1), F.size("v")), F.col("v"), lambda i, x: i * x), F.lit(0.0), lambda s, x: s + x
    )
    return v.select("doc_id", used.cast("long").alias("used_dims"), F.round(check, 4).alias("checksum")).filter("used_dims > 0")


@query("hybrid_rrf", "R7 R1 R5 J3 W1 W2 W3 T2 T7 SO1", f"""
with {S.bm25(BENCH, DOCS)}, {S.ranked('bm', 'score', 30, 'lex')}, {SEM_SQL}, {S.ranked('sim', 'similarity', 30, 'sem', 'similarity >= 0.3')},
f as (select query_id, doc_id, l.rk lr, s.rk sr, coalesce(1.0 / (60 + l.rk), 0) + coalesce(1.0 / (60 + s.rk), 0) sc
  from lex l full join sem s using (query_id, doc_id)),
r as (select *, row_number() over (partition by query_id order by round(sc, 12) desc, sr nulls last, doc_id) rk from f)
select query_id, doc_id, lr as lexical_rank, sr as semantic_rank, round(sc, 8) as rrf_score, rk as rank from r where rk <= 10""")
def hybrid_rrf(spark, d):
    fused = fusion.reciprocal_rank_fusion(lexical_hits(spark, d, 30), semantic_hits(spark, d, 30), 10)
    return fused.select("query_id", "doc_id", "lexical_rank", "semantic_rank", F.round("rrf_score", 8).alias("rrf_score"), "rank")


@query("hybrid_rrf_boosted", "R8 W3", f"""
with {S.bm25(BENCH, DOCS)}, {S.ranked('bm', 'score', 50, 'lex')}, {SEM_SQL}, {S.ranked('sim', 'similarity', 50, 'sem')},
f as (select query_id, doc_id, l.rk - 1 lr, s.rk - 1 sr, coalesce(1.0 / (59 + s.rk), 0) + coalesce((1 + least(l.score, 10) / 10) / (59 + l.rk), 0) sc
  from lex l full join sem s using (query_id, doc_id)),
r as (select *, row_number() over (partition by query_id order by round(sc, 12) desc, sr nulls last, doc_id) rk from f)
select query_id, doc_id, round(sc, 8) as boosted, rk as rank from r where rk <= 24""")
def hybrid_rrf_boosted(spark, d):
    fused = fusion.boosted_fusion(lexical_hits(spark, d, 50), semantic_hits(spark, d, 50, None), 24)
    return fused.select("query_id", "doc_id", F.round("boosted", 8).alias("boosted"), "rank")


@query("weighted_fusion", "R9", f"""
with {S.bm25(BENCH, DOCS)}, {S.ranked('bm', 'score', 20, 'lex')}, {SEM_SQL}, {S.ranked('sim', 'similarity', 20, 'sem', 'similarity >= 0.3')}
select query_id, doc_id, round(coalesce(score, 0) * 0.5 + coalesce(similarity, 0) * 0.5, 8) as score
from lex full join sem using (query_id, doc_id)""")
def weighted_fusion(spark, d):
    mixed = fusion.weighted_sum(lexical_hits(spark, d, 20), semantic_hits(spark, d, 20), 0.5, 0.5)
    return mixed.select("query_id", "doc_id", "score")


@query("diversified_results", "R13 W12", f"""
with {S.bm25(BENCH, DOCS)}, {S.ranked('bm', 'score', 24, 'top')},
s as (select t.*, source, row_number() over (partition by query_id, source order by rk) nth from top t join documents using (doc_id))
select query_id, doc_id, source, rk as rank, row_number() over (partition by query_id order by rk) as diverse_rank
from s where rk <= 3 or nth = 1""")
def diversified_results(spark, d):
    src = load(spark, d, "documents").select("doc_id", "source")
    ranked = lexical_hits(spark, d, 24).join(src, "doc_id")
    return fusion.diversify(ranked, "source").select("query_id", "doc_id", "source", "rank", "diverse_rank")


@query("chunk_lookup", "R12 PF21 Z1", """
select vec_id as chunk_id, label, source, lang, n_chars from embeddings join documents on doc_id = vec_id""")
def chunk_lookup(spark, d):
    meta = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "lang", "n_chars")
    chunks = load(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id").drop("embedding")
    return chunks.join(meta, "chunk_id").select("chunk_id", "label", "source", "lang", "n_chars")


@query("ann_probe", "R6 M6", f"""
with {S.CENTROIDS},
qx as (select source, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings join documents on doc_id = vec_id),
qm as (select source, i, avg(x) x from qx group by 1, 2), q as (select source, list(x order by i) qv from qm group by 1),
c as (select source, label, row_number() over (partition by source order by round(list_cosine_similarity(qv, v), 6) desc, label) rk from q cross join cen),
s as (select source query_id, vec_id doc_id, round(list_cosine_similarity(qv, embedding::double[]), 6) similarity
  from c join q using (source) join embeddings using (label) where rk <= 3),
{S.ranked('s', 'similarity', 5, 'top')}
select query_id, doc_id as chunk_id, similarity, rk as rank from top""")
def ann_probe(spark, d):
    vec = load(spark, d, "embeddings")
    site = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    q = nearest.centroids(vec.join(site, "vec_id"), "source").withColumnRenamed("source", "query_id")
    cells = nearest.centroids(vec, "label").select(F.col("label").cast("long").alias("cell_id"), "vector")
    chunks = vec.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("cell_id"), F.col("embedding").alias("vector"))
    return nearest.probe_centroids(q, chunks, cells, 5, probes=3)


@query("quick_evaluation", "R15", f"""
with {S.bm25(BENCH, DOCS)}, {S.ranked('bm', 'score', 10, 'lex')}, {SEM_SQL}, {S.ranked('sim', 'similarity', 10, 'sem', 'similarity >= 0.3')},
l3 as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) k3 from bm) where k3 <= 30),
s3 as (select * from (select *, row_number() over (partition by query_id order by similarity desc, doc_id) k3 from sim where similarity >= 0.3) where k3 <= 30),
f as (select query_id, doc_id, l3.k3 lr, s3.k3 sr, coalesce(1.0 / (60 + l3.k3), 0) + coalesce(1.0 / (60 + s3.k3), 0) sc from l3 full join s3 using (query_id, doc_id)),
h as (select *, row_number() over (partition by query_id order by round(sc, 12) desc, sr nulls last, doc_id) rk from f),
u as (select 'fulltext' as mode, query_id, doc_id, rk from lex union all select 'semantic', query_id, doc_id, rk from sem
 union all select 'hybrid', query_id, doc_id, rk from h where rk <= 10)
select mode, query_id, count(*) as result_count, min(case when rk = 1 then doc_id end) as best_doc from u group by 1, 2""")
def quick_evaluation(spark, d):
    modes = three_modes(spark, d)
    best = F.min(F.when(F.col("rank") == 1, F.col("doc_id")))
    return modes.groupBy("mode", "query_id").agg(F.count(F.lit(1)).alias("result_count"), best.alias("best_doc"))


def three_modes(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """(mode, query_id, doc_id, rank) of full-text, semantic and hybrid search for every benchmark text."""
    # a few ranked rows per query, each used twice below: kept once in the shared folder
    lex, sem = cut_lineage(lexical_hits(spark, d, 3 * k)), cut_lineage(semantic_hits(spark, d, 3 * k))
    hybrid = fusion.reciprocal_rank_fusion(lex, sem, k)
    parts = [("fulltext", lex), ("semantic", sem), ("hybrid", hybrid)]
    picked = [p.filter(F.col("rank") <= k).select(F.lit(m).alias("mode"), "query_id", "doc_id", "rank") for m, p in parts]
    return picked[0].unionByName(picked[1]).unionByName(picked[2])


@query("stem_vocabulary", "ST11", None)
def stem_vocabulary(spark, d):
    """Porter stems of the corpus vocabulary with their document counts."""
    docs = lexical.tokenised(load_spread(spark, d, "documents", "doc_id"), "doc_id", F.col("text"))
    words = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    stems = stem_terms(words)
    return stems.groupBy("stem").agg(F.count(F.lit(1)).alias("terms"), F.sum("docs").alias("uses"))


@query("vector_list_count", "M6 R6", """
select count(*) as n, greatest(10, least(1000, floor(sqrt(count(*)))))::bigint as lists from embeddings""")
def vector_list_count(spark, d):
    return nearest.list_count(load(spark, d, "embeddings"))


def _every_hundredth(spark: SparkSession, d: str) -> DataFrame:
    return vector_chunks(spark, d).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def _trained_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = vector_chunks(spark, d)
    lists = nearest.list_count(rows).first().lists
    centres = vector_index.train_cells(rows, lists)
    return cut_lineage(vector_index.filed(rows, centres)), vector_index.cell_rows(spark, centres)


@query("ivf_search", "R6 M6", f"""
with s as (select q.vec_id query_id, c.vec_id doc_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) similarity
  from embeddings q cross join embeddings c where q.vec_id % 100 = 0),
{S.ranked('s', 'similarity', 10, 'top')}
select query_id, doc_id as chunk_id, similarity, rk as rank from top""")
def ivf_search(spark, d):
    """The ten nearest of all vectors to every hundredth, from trained cells.

    Probes find 0.95 of the true neighbours of up to 500 queries; cells beyond them are read where their bound allows for a
    nearer row, so the rows are the exact ones for any number of queries.
    """
    index, cells = _trained_index(spark, d)
    queries = _every_hundredth(spark, d)
    probes = vector_index.probes_for(queries, index, cells, 10, 0.95)
    return vector_index.exact_search(queries, index, cells, 10, probes)


@query("ivf_recall", "R6 M6", """
with q as (select vec_id from embeddings where vec_id % 100 = 0)
select (select count(*) from q) as queries, (select count(*) from q) * least(10, (select count(*) from embeddings)) as true_neighbours, true as reached""")
def ivf_recall(spark, d):
    """Share of the exact neighbours that the probed cells hold, against 0.9; similarities are the exact ones."""
    index, cells = _trained_index(spark, d)
    queries = _every_hundredth(spark, d)
    probes = vector_index.probes_for(queries, index, cells, 10, 0.95)
    exact = nearest.top_k_similar(queries, vector_chunks(spark, d), 10)
    found = vector_index.search(queries, index, cells, 10, probes).select("query_id", "chunk_id", F.col("similarity").alias("_s"))
    both = exact.join(found, ["query_id", "chunk_id"], "left")
    return both.agg(
        F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("true_neighbours"),
        (F.count_if(F.col("_s") == F.col("similarity")) >= 0.9 * F.count(F.lit(1))).alias("reached"),
    )


@query("cover_density", "R2", f"""
with d as (select doc_id, {S.toks('text')} tk from documents),
q as (select query_id, term, row_number() over (partition by query_id order by term) t, count(*) over (partition by query_id) nt from (
  select item_id query_id, unnest(list_distinct({S.toks('text')})) term from benchmark) where term not in ({_STOP_SQL})),
p as (select doc_id, unnest(tk) term, generate_subscripts(tk, 1) pos from d),
h as (select query_id, doc_id, t, nt, pos from q join p using (term)),
c as (select query_id, doc_id from h group by 1, 2 having count(distinct t) = max(nt)),
n as (select h.*, row_number() over (partition by query_id, doc_id order by pos) i from h semi join c using (query_id, doc_id)),
l as (select a.query_id, a.doc_id, a.i, a.pos, a.nt, b.t, max(b.i) last from n a join n b on a.query_id = b.query_id and a.doc_id = b.doc_id and b.i <= a.i group by all),
m as (select query_id, doc_id, i, pos, min(last) low from l group by query_id, doc_id, i, pos, nt having count(*) = nt),
e as (select *, lag(low) over (partition by query_id, doc_id order by i) before from m)
select query_id, doc_id, count(*) as covers, round(sum(0.1::double / (1 + e.pos - n.pos - (e.i - e.low))), 6) as score
from e join n using (query_id, doc_id) where n.i = e.low and (before is null or low > before) group by 1, 2""")
def cover_density(spark, d):
    docs = lexical.tokenised(load_spread(spark, d, "documents", "doc_id"), "doc_id", F.col("text"))
    return proximity.cover_density(bench_queries(spark, d), docs, STOP)


_BARE = "lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))"


@query("best_snippets", "ST10", f"""
with {S.bm25(BENCH, DOCS)}, {S.ranked('bm', 'score', 10, 'top')},
q as (select item_id query_id, list_filter(list_distinct({S.toks('text')}), lambda t: t not in ({_STOP_SQL})) needles from benchmark),
w as (select query_id, doc_id, needles, {S.words('text')} ws from top join documents using (doc_id) join q using (query_id)),
i as (select query_id, doc_id, ws, list_transform(ws, lambda x: coalesce(list_position(needles, {_BARE}), 0)) hit from w),
s as (select *, list_filter(range(1, len(ws) + 1), lambda k: hit[k] > 0) starts from i),
k as (select *, list_transform(starts, lambda b: len(list_distinct(list_filter(hit[b:b + 7], lambda p: p > 0)))) kinds from s where len(starts) > 0),
b as (select *, list_max(kinds) best, starts[list_position(kinds, list_max(kinds))] f from k),
e as (select *, list_max(list_filter(starts, lambda x: x between f and f + 7)) - f + 1 span from b),
a as (select *, greatest(1, least(f - (8 - span) // 2, len(ws) - 7)) st from e)
select query_id, doc_id, best as kinds, (case when st > 1 then '…' else '' end) || array_to_string(list_transform(range(st, least(st + 8, len(ws) + 1)),
  lambda x: case when hit[x] > 0 then '<b>' || ws[x] || '</b>' else ws[x] end), ' ') || (case when st + 7 < len(ws) then '…' else '' end) as snippet from a""")
def best_snippets(spark, d):
    """For the ten best documents of every query, the window with the most of its terms."""
    texts = load_spread(spark, d, "documents", "doc_id")
    needles = F.array_except(tokens(F.col("query_text")), F.array(*[F.lit(w) for w in STOP]))
    queries = bench_queries(spark, d).select("query_id", needles.alias("needles"))
    hits = texts.select("doc_id", "text").join(sent_small(lexical_hits(spark, d, 10).select("query_id", "doc_id")), "doc_id").join(queries, "query_id")
    shown = hits.select("query_id", "doc_id", proximity.best_window(F.col("text"), F.col("needles")).alias("_b")).filter("_b is not null")
    return shown.select("query_id", "doc_id", F.col("_b.kinds").cast("long").alias("kinds"), F.col("_b.snippet").alias("snippet"))
