"""Registered queries: chunkers and section extractors over every document and page."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import ids
from folioscan.operators import chunking, sections
from folioscan.plans import fixtures as X
from folioscan.plans import sqltext as S
from folioscan.plans.registry import query
from folioscan.session import load_spread

# greedy packing as a recursion over numbered pieces ps(g, i, p): one row per piece with the open buffer
_H2 = f"""{X.MD_SQL},
parts as (select doc_id, unnest(string_split(regexp_replace(body, '(?m)^##+\\s+(.*)$', chr(1) || '\\1' || chr(2), 'g'), chr(1))) p,
  generate_subscripts(string_split(regexp_replace(body, '(?m)^##+\\s+(.*)$', chr(1) || '\\1' || chr(2), 'g'), chr(1)), 1) - 1 section from md),
secs as (select doc_id, section, case when section = 0 then 'Introduction' else {S.strip("split_part(p, chr(2), 1)")} end heading,
  case when section = 0 then {S.strip('p')} else {S.strip("split_part(p, chr(2), 2)")} end block from parts),
ps as (select doc_id, section, unnest(regexp_split_to_array(block, '\\n\\s*\\n')) p, generate_subscripts(regexp_split_to_array(block, '\\n\\s*\\n'), 1) i from secs where section > 0),
pack as (select doc_id, section, i, p cur, null::varchar done from ps where i = 1
  union all select k.doc_id, k.section, n.i,
    case when length(cur) + length(n.p) > 1000 and {S.strip('cur')} <> '' then n.p when cur = '' then n.p else cur || chr(10) || chr(10) || n.p end,
    case when length(cur) + length(n.p) > 1000 and {S.strip('cur')} <> '' then {S.strip('cur')} end
  from pack k join ps n on n.doc_id = k.doc_id and n.section = k.section and n.i = k.i + 1),
outs as (select doc_id, section, i, done content from pack where done is not null
  union all select doc_id, section, 1000000000, {S.strip('arg_max(cur, i)')} from pack group by 1, 2 having {S.strip('arg_max(cur, i)')} <> ''
  union all select doc_id, section, 1, block from secs where section = 0 and block <> '')"""


@query("md_h2_chunks", "CH1 SRC2 ST1 ST7", f"""
with recursive {_H2}
select o.doc_id, o.section::int as section, (row_number() over (partition by o.doc_id, o.section order by i) - 1)::int as part, heading,
 regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as anchor, content
from outs o join secs s on s.doc_id = o.doc_id and s.section = o.section""")
def md_h2_chunks(spark, d):
    return chunking.h2_chunks(X.markdown_docs(spark, d), "doc_id", "body")


@query("paragraph_chunks", "CH8 I4 H6", f"""
with recursive {X.MD_SQL}, ps as (select doc_id, unnest(string_split(body, chr(10) || chr(10))) p, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) i from md),
pack as (select doc_id, i, p cur, null::varchar done from ps where i = 1
  union all select k.doc_id, n.i, case when length(cur) + length(n.p) > 1000 and cur <> '' then n.p when cur = '' then n.p else cur || chr(10) || chr(10) || n.p end,
    case when length(cur) + length(n.p) > 1000 and cur <> '' then {S.strip('cur')} end from pack k join ps n on n.doc_id = k.doc_id and n.i = k.i + 1),
outs as (select doc_id, i, done content from pack where done is not null
  union all select doc_id, 1000000000, {S.strip('arg_max(cur, i)')} from pack group by 1 having {S.strip('arg_max(cur, i)')} <> ''),
num as (select doc_id, content, row_number() over (partition by doc_id order by i) - 1 c from outs)
select doc_id, c::int as chunk_index, content, md5('doc/' || doc_id || ':' || c || ':1.0:1.0') as lineage_id from num""")
def paragraph_chunks(spark, d):
    md = X.markdown_docs(spark, d)
    cut = md.select("doc_id", F.posexplode(chunking.pack_paragraphs(F.col("body"))).alias("chunk_index", "content"))
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return cut.withColumn("lineage_id", ids.chunk_lineage_id(url, F.col("chunk_index"), F.lit("1.0"), F.lit("1.0")))


@query("size_chunks", "CH2", """
with recursive cut as (select doc_id, text, 0 s, case when length(text) <= 1000 then length(text) else
    case when length(text) > 1000 and length(regexp_extract(substring(text, 801, 200), '(?s)^(.*[.!?]\\s+)', 1)) > 0
      then 800 + length(regexp_extract(substring(text, 801, 200), '(?s)^(.*[.!?]\\s+)', 1)) else 1000 end end e from documents
  union all select doc_id, text, e, case when e + 1000 < length(text) and length(regexp_extract(substring(text, e + 801, 200), '(?s)^(.*[.!?]\\s+)', 1)) > 0
      then e + 800 + length(regexp_extract(substring(text, e + 801, 200), '(?s)^(.*[.!?]\\s+)', 1)) else e + 1000 end from cut where e < length(text)),
c as (select doc_id, s, case when length(text) <= 1000 then text else regexp_replace(substring(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') end content, length(text) <= 1000 whole from cut)
select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as chunk_index, content from c where whole or length(content) >= 100""")
def size_chunks(spark, d):
    docs = load_spread(spark, d, "documents", "doc_id")
    return docs.select("doc_id", F.posexplode(chunking.size_windows(F.col("text"))).alias("chunk_index", "content"))


@query("overlapping_size_chunks", "CH2", """
with recursive cut as (select doc_id, text, 0 s, case when length(text) <= 1000 then length(text) when length(regexp_extract(substring(text, 801, 200), '(?s)^(.*[.!?]\\s+)', 1)) > 0
      then 800 + length(regexp_extract(substring(text, 801, 200), '(?s)^(.*[.!?]\\s+)', 1)) else 1000 end e from documents
  union all select doc_id, text, e - 200, case when e + 800 < length(text) and length(regexp_extract(substring(text, e + 601, 200), '(?s)^(.*[.!?]\\s+)', 1)) > 0
      then e + 600 + length(regexp_extract(substring(text, e + 601, 200), '(?s)^(.*[.!?]\\s+)', 1)) else e + 800 end from cut where e < length(text)),
c as (select doc_id, case when length(text) <= 1000 then text else regexp_replace(substring(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') end content, length(text) <= 1000 whole from cut)
select doc_id, count(*) as chunks, max(length(content))::int as longest from c where whole or length(content) >= 100 group by 1""")
def overlapping_size_chunks(spark, d):
    docs = load_spread(spark, d, "documents", "doc_id")
    cut = docs.select("doc_id", F.posexplode(chunking.size_windows(F.col("text"), overlap=200)).alias("chunk_index", "content"))
    return cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("content")).alias("longest"))


_SENT = lambda x: f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("sentence_overlap_chunks", "CH4 ST6", f"""
with recursive ps as (select doc_id, unnest({_SENT('text')}) p, generate_subscripts({_SENT('text')}, 1) i from documents),
pack as (select doc_id, i, p cur, null::varchar done from ps where i = 1
  union all select k.doc_id, n.i, case when cur <> '' and length(cur) + length(n.p) > 600 then
      case when length(cur) > 200 and len({_SENT("right(cur, 200)")}) > 1 then array_to_string(({_SENT("right(cur, 200)")})[2:], ' ') || ' ' || n.p else n.p end
      when cur = '' then n.p else cur || ' ' || n.p end,
    case when cur <> '' and length(cur) + length(n.p) > 600 then {S.strip('cur')} end from pack k join ps n on n.doc_id = k.doc_id and n.i = k.i + 1),
outs as (select doc_id, i, done content from pack where done is not null
  union all select doc_id, 1000000000, {S.strip('arg_max(cur, i)')} from pack group by 1 having {S.strip('arg_max(cur, i)')} <> '')
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_index, content from outs""")
def sentence_overlap_chunks(spark, d):
    pieces = chunking.pack_sentences(F.col("text"), 600, 200)
    return load_spread(spark, d, "documents", "doc_id").select("doc_id", F.posexplode(pieces).alias("chunk_index", "content"))


_LINES = f"""{X.MD_SQL}, ln as (select doc_id, unnest(string_split(body, chr(10))) l, generate_subscripts(string_split(body, chr(10)), 1) - 1 i from md),
off as (select *, coalesce(sum(length(l) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::int o from ln),
hd as (select doc_id, i, o, l, length(regexp_extract(l, '^(#{{1,6}})\\s', 1)) level, {S.strip("regexp_extract(l, '^#{1,6}\\s+(.+)$', 1)")} h,
  regexp_matches(l, '^#{{1,6}}\\s+.+$') is_h from off),
nb as (select *, sum(case when is_h then 1 else 0 end) over (partition by doc_id order by i) sec from hd)"""


@query("heading_scan", "Z4", f"""
with {_LINES} select doc_id, level::int as level, h as heading, o as offset from hd where is_h""")
def heading_scan(spark, d):
    md = X.markdown_docs(spark, d).withColumn("lines", F.split("body", "\n"))
    h = md.select("doc_id", F.inline(sections.heading_list(F.col("lines"), stripped=True)))
    return h.select("doc_id", "level", F.col("text").alias("heading"), "offset")


@query("diff_sections", "CH9 W7 H5 A1", f"""
with {_LINES}, top as (select *, max(case when is_h and level = 1 then h end) over (partition by doc_id) h1, max(case when is_h and level = 2 then h end) over (partition by doc_id) h2 from nb),
s as (select doc_id, sec, max(case when is_h then h end) h, max(case when is_h then level end) level, any_value(h1) h1, any_value(h2) h2,
  string_agg(l || chr(10), '' order by i) filter (not is_h) raw, min(case when is_h then o + length(l) + 1 else o end) filter (is_h or sec = 0) st, max(o + length(l) + 1) en from top group by 1, 2)
select doc_id, substr(sha256('doc/' || doc_id || '#' || coalesce(h, 'Document Root') || '#' || substring(raw, 1, 100)), 1, 16) as section_id,
 coalesce(h, 'Document Root') as heading, {S.strip('raw')} as content, sha256(raw) as content_hash, coalesce(level, 0)::int as level,
 case level when 1 then h1 when 2 then h1 || ' > ' || h2 when 3 then h1 || ' > ' || h2 || ' > ' || h else '' end as path, st::int as start_pos, en::int as end_pos
from s where {S.strip("coalesce(raw, '')")} <> ''""")
def diff_sections(spark, d):
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return sections.body_sections(X.markdown_docs(spark, d), "doc_id", url, "body")


@query("heading_asof", "J15", f"""
with {_LINES} select doc_id, i::int as line, max(case when is_h then h end) over (partition by doc_id, sec) as heading from nb""")
def heading_asof(spark, d):
    return sections.governing_heading(X.markdown_docs(spark, d), "doc_id", "body")


_HSEC = f"""{_LINES}, hs as (select doc_id, sec, {S.strip("string_agg(l, chr(10) order by i)")} content, max(case when is_h then level end) level, max(case when is_h then h end) h from nb group by 1, 2),
hp as (select *, max(case when level = 1 then h end) over (partition by doc_id) h1, max(case when level = 2 then h end) over (partition by doc_id) h2 from hs),
ht as (select doc_id, sec, content, case level when 1 then h1 when 2 then h1 || '|' || h2 when 3 then h1 || '|' || h2 || '|' || h else 'root' end path from hp where content <> '')"""


@query("heading_hierarchy_chunks", "CH3 CH4 H3 W7", f"""
with recursive {_HSEC},
ps as (select doc_id, sec, path, unnest({_SENT('content')}) p, generate_subscripts({_SENT('content')}, 1) i from ht where length(content) > 2048),
pack as (select doc_id, sec, path, i, p cur, null::varchar done from ps where i = 1
  union all select k.doc_id, k.sec, k.path, n.i, case when cur <> '' and length(cur) + length(n.p) > 2048 then
      case when length(cur) > 1024 and len({_SENT("right(cur, 1024)")}) > 1 then array_to_string(({_SENT("right(cur, 1024)")})[2:], ' ') || ' ' || n.p else n.p end
      when cur = '' then n.p else cur || ' ' || n.p end,
    case when cur <> '' and length(cur) + length(n.p) > 2048 then {S.strip('cur')} end from pack k join ps n on n.doc_id = k.doc_id and n.sec = k.sec and n.i = k.i + 1),
outs as (select doc_id, sec, path, i, done content from pack where done is not null
  union all select doc_id, sec, any_value(path), 1000000000, {S.strip('arg_max(cur, i)')} from pack group by 1, 2
  union all select doc_id, sec, path, 1, content from ht where length(content) <= 2048),
num as (select *, (row_number() over (partition by doc_id order by sec, i) - 1)::int c from outs where content <> '')
select doc_id, c as chunk_index, substr(md5(doc_id || '#' || path || '#' || c), 1, 12) as chunk_id, path, content from num""")
def heading_hierarchy_chunks(spark, d):
    c = chunking.heading_chunks(X.markdown_docs(spark, d), "doc_id", "body")
    path = F.when(F.size("h_path") > 0, F.array_join("h_path", "|")).otherwise("root")
    return c.select("doc_id", "chunk_index", "chunk_id", path.alias("path"), "content")


@query("content_router", "CH6", f"""
with {X.MD_SQL}, a as (select 'd' || doc_id id, body c from md union all select 'p' || page_id, html from pages union all select 't' || doc_id, text from documents)
select id, case when regexp_matches(c, '(?m)^#{{1,6}}\\s+.+$') then 'markdown' when regexp_matches(c, '<[^>]+>') then 'html' else 'text' end as kind from a""")
def content_router(spark, d):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    md = X.markdown_docs(spark, d).select(tag("d", "doc_id"), F.col("body").alias("c"))
    pages = load_spread(spark, d, "pages", "page_id").select(tag("p", "page_id"), F.col("html").alias("c"))
    plain = load_spread(spark, d, "documents", "doc_id").select(tag("t", "doc_id"), F.col("text").alias("c"))
    return md.unionByName(pages).unionByName(plain).select("id", chunking.content_kind(F.col("c")).alias("kind"))


@query("word_window_chunks", "CH10 CH11", f"""
with w as (select doc_id, text, {S.words('text')} ws from documents),
x as (select doc_id, unnest(case when length(text) <= 1000 then [0] else range(0, greatest(len(ws), 1), 850) end) s, text, ws from w)
select doc_id, (s // 850)::int as chunk_index, case when length(text) <= 1000 then text else array_to_string(ws[s + 1:s + 1000], ' ') end as content,
 substr(sha256(doc_id || '|#body|' || (s // 850)), 1, 16) as chunk_id from x""")
def word_window_chunks(spark, d):
    cut = load_spread(spark, d, "documents", "doc_id").select("doc_id", F.posexplode(chunking.word_windows(F.col("text"))).alias("chunk_index", "content"))
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("#body"), F.col("chunk_index").cast("string"))
    return cut.withColumn("chunk_id", F.substring(F.sha2(key, 256), 1, 16))


@query("section_stack", "CH10", f"""
with {_LINES}, s as (select doc_id, sec, max(case when is_h then h end) h, max(case when is_h then level end) level, string_agg(l, chr(10) order by i) filter (not is_h) raw from nb group by 1, 2),
p as (select *, max(case when level = 1 then h end) over (partition by doc_id) h1, max(case when level = 2 then h end) over (partition by doc_id) h2 from s)
select doc_id, coalesce(h, 'Introduction') as title, case level when 1 then h1 when 2 then h1 || ' > ' || h2 when 3 then h1 || ' > ' || h2 || ' > ' || h else '' end as path,
 length({S.strip('raw')}) as size from p where {S.strip("coalesce(raw, '')")} <> ''""")
def section_stack(spark, d):
    s = sections.body_sections(X.markdown_docs(spark, d), "doc_id", F.lit(""), "body", root_name="Introduction", root_path=["Introduction"])
    return s.select("doc_id", F.col("heading").alias("title"), "path", F.length("content").cast("long").alias("size"))


_BLOCKS = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
  '(?is)<(/?)(h[1-6]|p|div|section)\\b[^>]*>', chr(1) || '\\1\\2' || chr(2), 'g')"""


def _plain(x: str) -> str:
    return f"replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


_HTML_SEC = f"""bl as (select page_id, unnest(string_split({_BLOCKS}, chr(1))) p, generate_subscripts(string_split({_BLOCKS}, chr(1)), 1) i from pages),
bt as (select page_id, i, lower(split_part(p, chr(2), 1)) tag, {S.strip(_plain("split_part(p, chr(2), 2)"))} t from bl where i > 1),
bk as (select *, regexp_matches(tag, '^h[1-6]$') is_h from bt where regexp_matches(tag, '^h[1-6]$') or (t <> '' and not regexp_matches(tag, '^/(div|section|h[1-6])$'))),
bs as (select *, sum(case when is_h then 1 else 0 end) over (partition by page_id order by i) sec from bk),
hsec as (select page_id, sec, max(case when is_h then t end) heading, max(case when is_h then cast(substr(tag, 2, 1) as integer) end) as level,
  string_agg(t, ' ' order by i) filter (not is_h) content from bs group by 1, 2 having count(case when not is_h then 1 end) > 0)"""


@query("html_heading_sections", "CH5 U6", f"""
with {_HTML_SEC} select page_id, (row_number() over (partition by page_id order by sec) - 1)::int as pos, heading, level, content from hsec""")
def html_heading_sections(spark, d):
    return sections.html_sections(load_spread(spark, d, "pages", "page_id"), "page_id", "html")


@query("html_heading_chunks", "CH5 CH2", f"""
with recursive {_HTML_SEC}, doc as (select page_id, sec, heading, case when heading is null then content else heading || chr(10) || chr(10) || content end text from hsec),
cut as (select page_id, sec, heading, text, 0 s, case when length(text) <= 1000 then length(text) when length(regexp_extract(substring(text, 801, 200), '(?s)^(.*[.!?]\\s+)', 1)) > 0
      then 800 + length(regexp_extract(substring(text, 801, 200), '(?s)^(.*[.!?]\\s+)', 1)) else 1000 end e from doc
  union all select page_id, sec, heading, text, e, case when e + 1000 < length(text) and length(regexp_extract(substring(text, e + 801, 200), '(?s)^(.*[.!?]\\s+)', 1)) > 0
      then e + 800 + length(regexp_extract(substring(text, e + 801, 200), '(?s)^(.*[.!?]\\s+)', 1)) else e + 1000 end from cut where e < length(text)),
c as (select *, case when length(text) <= 1000 then text else {S.strip('substring(text, s + 1, e - s)')} end content from cut)
select page_id, heading, (row_number() over (partition by page_id, sec order by s) - 1)::int as part, content from c where length(text) <= 1000 or length(content) >= 100""")
def html_heading_chunks(spark, d):
    return chunking.html_chunks(load_spread(spark, d, "pages", "page_id"), "page_id", "html").select("page_id", "heading", "part", "content")


@query("chunk_documents", "CH6 CH7 Z7 H4 PF18", None)
def chunk_documents(spark, d):
    """All three content kinds through the router; one row per kept chunk."""
    col = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("url")
    md = X.markdown_docs(spark, d).select(col("md/", "doc_id"), F.col("body").alias("content"))
    pages = load_spread(spark, d, "pages", "page_id").select(col("page/", "page_id"), F.col("html").alias("content"))
    plain = load_spread(spark, d, "documents", "doc_id").select(col("text/", "doc_id"), F.col("text").alias("content"))
    docs = md.unionByName(pages).unionByName(plain).withColumn("title", F.lit("")).withColumn("source_name", F.lit("crawl"))
    return chunking.chunk_documents(docs).select("url", "chunk_id", "chunk_index", "heading", "token_count", "content_hash", "lineage_id")
