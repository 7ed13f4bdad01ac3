"""Queries opN_<name>: each operator over its whole table, with a SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from folioscan.llm import byte_bpe, collocations, cover_tree, importance, language_id, license_scan, mixing, near_dedup, preference, private_data, quality_rules, token_counts
from folioscan.llm import exact_dedup as dedup
from folioscan.llm.common import documents
from folioscan.plans.registry import Entry
from folioscan.session import load

OP4_SQL = r"""
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id is not distinct from min(doc_id) over g as kept, text_sha256
from (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
window g as (partition by text_sha256)
"""

OP10_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5(concat_ws(':', 'mix-1', cast(doc_id as varchar))), 1, 4) as integer) as cell
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
w as (
  select source, source_size, 2 * source_size as cap,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
    1.5::double * sum(source_size) over () as total
  from s),
o as (
  select *, coalesce(sum(cap) over (order by cap::double / weight, source rows between unbounded preceding and 1 preceding), 0)::double as closed,
    sum(weight) over (order by cap::double / weight, source rows between current row and unbounded following)::double as open_weight
  from w),
l as (select max((total - closed) / open_weight) as level from o),
t as (select source, source_size, least(cap::double, weight * (select level from l)) as target from w),
p as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole,
    target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size as rest
  from t),
e as (
  select source, cell, sum(size) over (partition by source order by cell) as stop
  from (select source, cell, sum(size) as size from d group by 1, 2)),
b as (
  select source, arg_min(cell, struct_pack(off := off, cell := cell)) as cell, min(off) as off, max(rest) as rest
  from (select e.source, e.cell, abs(e.stop - p.rest) as off, p.rest from e join p on e.source is not distinct from p.source)
  group by 1)
select d.doc_id, cast(d.size as bigint) as size, p.source_size, round(p.target, 6) as target,
  cast(d.size * (p.whole + case when d.cell <= (case when b.off <= b.rest then b.cell else -1 end) then 1 else 0 end) as bigint) as taken
from d join p on d.source is not distinct from p.source join b on d.source is not distinct from b.source
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates over the whole of documents."""
    return dedup.exact_dedup(documents(spark, sf_dir))


OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle
  from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as both from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c.both >= 75 * (x.n + y.n - c.both)),
r(a, b) as (
  select a, b from (select a, b from l union all select b, a from l)
  union
  select r.a, l.b from r join (select a, b from l union all select b, a from l) l on r.b = l.a),
m as (select a as doc_id, min(b) as low from r group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) as component_id,
  w.doc_id = least(w.doc_id, coalesce(m.low, w.doc_id)) as kept
from w left join n on n.doc_id = w.doc_id left join m on m.doc_id = w.doc_id
"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in all documents; no SQL twin for the sweep, tested against brute force."""
    return license_scan.license_scan(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again; no SQL twin, tested against the library."""
    return byte_bpe.digests(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; no SQL twin, tested against the library."""
    return token_counts.token_counts(documents(spark, sf_dir))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; no SQL twin for the added terms, tested against brute force."""
    return private_data.private_data(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and anomaly of all documents; no SQL twin for the forest, the counts are tested against brute force."""
    return quality_rules.quality_rules(documents(spark, sf_dir), load(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; no SQL twin, tested by held-out declarations and a brute-force fusion."""
    return language_id.identified(language_id.of_documents(documents(spark, sf_dir))).withColumnRenamed("key", "doc_id")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all web pages: markup language, host suffix and host."""
    return language_id.identified(language_id.of_pages(load(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates over the whole of documents."""
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op9_preference_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; no SQL twin, tested by held-out accuracy."""
    return preference.ranked(documents(spark, sf_dir), load(spark, sf_dir, "labels"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150 % of their size."""
    return mixing.mixture(documents(spark, sf_dir))


OP11_SQL = r"""
with t as (select list(c order by n) as tab from (
  select n, list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
  from (select unnest(range(256)) as n))),
w as (
  select 'd' as kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
r as (
  select kind, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as feature
  from w),
f as (select kind, doc_id, feature, count(*) as times from r group by 1, 2, 3),
b as (
  select feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(cast(len(h) / 2 as bigint)), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select feature, hex(encode(feature)) as h from (select distinct feature from f)), t),
k as (select kind, doc_id, bucket, cast(sum(times) as bigint) as times from f join b using (feature) group by 1, 2, 3),
n as (select unnest(range(10000)) as bucket),
s as (select bucket, cast(coalesce(sum(times) filter (kind = 'd'), 0) as double) as s, cast(coalesce(sum(times) filter (kind = 'b'), 0) as double) as t from n left join k using (bucket) group by 1),
g as (
  select bucket, cast(floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000)))) as bigint) as gain from s),
x as (select doc_id, cast(sum(times) as bigint) as n_features, cast(sum(times * gain) as bigint) as weight from k join g using (bucket) where kind = 'd' group by 1),
d as (
  select w.doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    cast('0x' || substr(sha256('42:' || w.doc_id), 1, 8) as bigint) as h
  from w left join x using (doc_id) where kind = 'd'),
c as (select doc_id, n_words, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from d),
p as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as fit from c)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * fit // 100 then place end as rank from p
"""

OP12_SQL = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

OP13_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, sum(len(w)) as n from w group by 1),
f as materialized (
  select lang, k, phrase, count(*) as f from (
    select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
    from (select lang, w, unnest([1, 2, 3]) as k from w))
  group by 1, 2, 3 having count(*) >= 10),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
e as materialized (
  select lang, k, phrase, a, j, array_to_string(w[1:j], ' ') as head, array_to_string(w[j + 1:k], ' ') as tail
  from (select *, unnest(range(1, k)) as j from c)),
u as (
  select e.lang, e.phrase, e.a, j, x.f as l, y.f as r, cast(1000000::hugeint * e.a * e.a // (x.f::hugeint * y.f) as bigint) as score
  from e join f x on x.lang = e.lang and x.phrase = head join f y on y.lang = e.lang and y.phrase = tail),
b as (select * from u qualify row_number() over (partition by lang, phrase order by score, j) = 1),
o as (
  select lang, phrase, max(a) as around from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from c where k = 3)
  group by 1, 2),
x as (
  select b.lang, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as rank, b.phrase, b.a, l, r, score
  from b left join o on o.lang = b.lang and o.phrase = b.phrase where around is null or 100 * around < 50 * b.a)
select x.lang, rank, phrase, a, l, r, cast(n.n as bigint) as n, score from x join n on n.lang = x.lang where rank <= 2000
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark's texts."""
    return importance.resampled(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


def op12_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors to every fiftieth."""
    return cover_tree.top_products(load(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of all documents by language."""
    return collocations.collocations(documents(spark, sf_dir)).drop("first_doc")


def entries() -> dict[str, Entry]:
    return {
        "pipeline": Entry(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL, ("LLM2", "LLM4", "LLM7", "LLM8", "LLM10")),
        "op1_license_scan": Entry(op1_license_scan, None, ("LLM1",)),
        "op2_byte_bpe": Entry(op2_byte_bpe, None, ("LLM2",)),
        "op3_token_counts": Entry(op3_token_counts, None, ("LLM3",)),
        "op5_private_data": Entry(op5_private_data, None, ("LLM5",)),
        "op6_quality_rules": Entry(op6_quality_rules, None, ("LLM6",)),
        "op7_language_id": Entry(op7_language_id, None, ("LLM7",)),
        "page_languages": Entry(page_languages, None, ("LLM7",)),
        "op8_near_dedup": Entry(op8_near_dedup, OP8_SQL.strip(), ("LLM8",)),
        "op9_preference_ranking": Entry(op9_preference_ranking, None, ("LLM9",)),
        "op4_exact_dedup": Entry(op4_exact_dedup, OP4_SQL.strip(), ("LLM4",)),
        "op10_source_mix": Entry(op10_source_mix, OP10_SQL.strip(), ("LLM10",)),
        "op11_importance_resampling": Entry(op11_importance_resampling, OP11_SQL.strip(), ("LLM11",)),
        "op12_cover_tree_search": Entry(op12_cover_tree_search, OP12_SQL.strip(), ("LLM12",)),
        "op13_collocations": Entry(op13_collocations, OP13_SQL.strip(), ("LLM13",)),
    }
