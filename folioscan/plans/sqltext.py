"""Fragments of the DuckDB twins (kept apart from the Spark plans on purpose)."""

from __future__ import annotations


def toks(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower({expr})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda t: t <> '')"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def without_code(html: str) -> str:
    out = html
    for pattern in ("(?is)<script\\b[^>]*>.*?</script\\s*>", "(?is)<style\\b[^>]*>.*?</style\\s*>", "(?s)<!--.*?-->"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return out


def unescape(x: str) -> str:
    return f"replace(replace(replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def visible_text(html: str) -> str:
    lines = f"list_transform(string_split({unescape(f"regexp_replace({without_code(html)}, '<[^>]*>', '', 'g')")}, chr(10)), lambda l: {strip('l')})"
    phrases = f"list_transform(flatten(list_transform({lines}, lambda l: string_split(l, '  '))), lambda s: {strip('s')})"
    return f"array_to_string(list_filter({phrases}, lambda s: s <> ''), ' ')"


def bm25(queries: str, docs: str, name: str = "bm", join: str = "any") -> str:
    """CTEs ending in {name}(query_id, doc_id, score); inputs are (query_id, txt) and (doc_id, txt)."""
    having = "having count(*) = max(q.n_terms)" if join == "all" else ""
    return f"""
{name}_d as (select doc_id, {toks('txt')} tk from ({docs})),
{name}_p as (select doc_id, term, count(*) tf from (select doc_id, unnest(tk) term from {name}_d) group by 1, 2),
{name}_l as (select doc_id, len(tk) dl from {name}_d),
{name}_s as (select count(*) n, avg(dl) avgdl from {name}_l),
{name}_f as (select term, count(*) df from {name}_p group by 1),
{name}_q as (select query_id, unnest(tt) term, len(tt) n_terms
  from (select query_id, list_distinct({toks('txt')}) tt from ({queries}))),
{name} as (select q.query_id, p.doc_id, count(*) matched, round(sum(
    ln(1.0 + (s.n - f.df + 0.5) / (f.df + 0.5))
    * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / s.avgdl))), 6) score
  from {name}_q q join {name}_p p using (term) join {name}_f f using (term) join {name}_l l using (doc_id)
  cross join {name}_s s group by 1, 2 {having})"""


def embed(source: str, key: str, name: str, dims: int = 64) -> str:
    """CTE {name}(key, dim, w) holding unit-length hashed bags; input is (key, txt)."""
    return f"""
{name}_t as (select {key}, md5(t) h from (select {key}, unnest({toks('txt')}) t from ({source}))),
{name}_w as (select {key}, cast(('0x' || substr(h, 1, 7)) as bigint) % {dims} + 1 dim,
    sum(case when substr(h, 8, 1) in ('1','3','5','7','9','b','d','f') then -1.0 else 1.0 end) w
  from {name}_t group by 1, 2),
{name}_n as (select {key}, sqrt(sum(w * w)) n from {name}_w group by 1),
{name} as (select {key}, dim, w / n w from {name}_w join {name}_n using ({key}) where n > 0)"""


def ranked(source: str, score: str, k: int, name: str, where: str = "true") -> str:
    return f"""
{name} as (select * from (select *, row_number() over (partition by query_id order by {score} desc, doc_id) rk
  from {source} where {where}) where rk <= {k})"""


CENTROIDS = """
cen_x as (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings),
cen_m as (select label, i, avg(x) x from cen_x group by 1, 2),
cen as (select label, list(x order by i) v from cen_m group by 1)"""
