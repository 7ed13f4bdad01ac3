"""Registered queries: filters, projections, string and hash functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import html, ids, text
from folioscan.operators import filters
from folioscan.plans import fixtures as X
from folioscan.plans import sqltext as S
from folioscan.plans.registry import query
from folioscan.session import as_of, load, load_spread


@query("filter_lang_source", "PF1 PF3", """
select doc_id, lang, source, n_chars from documents where lang = 'en' and source = 'src1'""")
def filter_lang_source(spark, d):
    docs = filters.where_all(load(spark, d, "documents"), {"lang": "en", "source": "src1"})
    return docs.select("doc_id", "lang", "source", "n_chars")


@query("filter_source_like", "PF2 PF3", """
select page_id, url from pages where lower(url) like '%example.org%' and url like '%/en/%'""")
def filter_source_like(spark, d):
    pages = load(spark, d, "pages")
    return pages.filter(F.col("url").ilike("%example.org%") & F.contains(F.col("url"), F.lit("/en/"))).select("page_id", "url")


@query("filter_recent_events", "PF7 D2", """
select event_id, event_type from events where ts >= (select max(ts) from events) - interval 7 day""")
def filter_recent_events(spark, d):
    ev = load(spark, d, "events")
    return filters.within(ev, "ts", as_of(ev), days=7).select("event_id", "event_type")


@query("filter_null_safe_version", "PF8 PF14", f"""
with {X.CHUNKS_SQL} select chunk_id, chunker_version from chunks where chunker_version is distinct from 'v1.0.0'""")
def filter_null_safe_version(spark, d):
    return filters.differs(X.chunks(spark, d), "chunker_version", "v1.0.0").select("chunk_id", "chunker_version")


@query("embedding_present", "PF5 PF19", """
select d.doc_id, case when e.vec_id is null then 'missing' when len(embedding) = 0 then 'missing' else 'present' end as state
from documents d left join embeddings e on vec_id = doc_id""")
def embedding_present(spark, d):
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("n"))
    has = F.coalesce(F.col("n") > 0, F.lit(False))
    return load(spark, d, "documents").join(v, "doc_id", "left").select("doc_id", F.when(has, "present").otherwise("missing").alias("state"))


@query("page_keyset", "PF11 R14 T4", """
with p as (select url, title from (select url, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages)
  where url > 'https://' order by url limit 25)
select url, title, case when count(*) over () = 25 then max(url) over () end as next_cursor from p""")
def page_keyset(spark, d):
    p = load(spark, d, "pages").select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return filters.keyset_page(p, "url", "https://", 25)


@query("page_offset", "PF12 T8", """
select doc_id, n_chars from documents order by n_chars desc, doc_id limit 50 offset 50""")
def page_offset(spark, d):
    return load(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(50).limit(50)


@query("preview_text", "PF13", """
select doc_id, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as preview,
 substring(text, 1, 240) as snippet, substring(text, 1, 500) as excerpt from documents""")
def preview_text(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", text.preview(t, 200).alias("preview"), text.preview(t, 240, "").alias("snippet"), text.preview(t, 500, "").alias("excerpt")
    )


@query("glob_allow_deny", "PF15", """
select page_id, url, starts_with(url, 'https://') and regexp_matches(p, '^/(en|fr)/.*$') and not regexp_matches(p, '^.*/7.*$') as allowed
from (select page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) p from pages)""")
def glob_allow_deny(spark, d):
    p = load(spark, d, "pages")
    return p.select("page_id", "url", filters.within_rules(F.col("url"), "https://", ["/en/**", "/fr/*"], ["*/7**"]).alias("allowed"))


@query("url_whitelist_blacklist", "PF17 PF16", """
select page_id, case when regexp_matches(url, '(?i)\\.net/de/') then 'url_blacklisted'
  when regexp_matches(url, '(?i)^https://www\\.') then 'whitelisted' else 'check_robots' end as verdict from pages""")
def url_whitelist_blacklist(spark, d):
    verdict = filters.url_pattern_verdict(F.col("url"), [r"^https://www\."], [r"\.net/de/"])
    return load(spark, d, "pages").select("page_id", verdict.alias("verdict"))


@query("min_chunk_size", "PF18 CH7", f"""
with {X.CHUNKS_SQL} select document_id, chunk_index, length(content) as size from chunks where length(content) >= 100""")
def min_chunk_size(spark, d):
    return X.chunks(spark, d).filter(F.length("content") >= 100).select("document_id", "chunk_index", F.length("content").cast("long").alias("size"))


@query("min_word_count", "PF22 ST4", f"""
select doc_id, len({S.words('text')}) as word_count from documents where len({S.words('text')}) >= 50""")
def min_word_count(spark, d):
    n = F.size(text.words(F.col("text"))).cast("long")
    return load(spark, d, "documents").select("doc_id", n.alias("word_count")).filter("word_count >= 50")


@query("status_classes", "PF23 Z3 AGG22", """
with r as (select case event_type when 'error' then (case when value < 5 then 503 when value < 20 then 404 else 403 end)
  when 'signup' then 301 else 200 end status, case when event_type = 'view' then 'application/pdf' else 'text/html' end ctype from events)
select status, count(*) as n, bool_or(status in (408, 429, 500, 502, 503, 504)) as retryable,
 sum(case when ctype like 'text/%' then 1 else 0 end)::bigint as text_responses,
 case when status = 403 then 'blocked' when status = 200 then 'successful' when status between 300 and 399 then 'redirected' else 'failed' end as outcome
from r group by status""")
def status_classes(spark, d):
    e, v = F.col("event_type"), F.col("value")
    failed = F.when(v < 5, 503).when(v < 20, 404).otherwise(403)
    r = load(spark, d, "events").select(
        F.when(e == "error", failed).when(e == "signup", 301).otherwise(200).alias("status"),
        F.when(e == "view", "application/pdf").otherwise("text/html").alias("ctype"),
    )
    return r.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(filters.is_retryable(F.col("status"))).alias("retryable"),
        F.count_if(F.col("ctype").startswith("text/")).alias("text_responses"),
    ).withColumn("outcome", filters.crawl_outcome(F.col("status")))


@query("ordered_id_list", "PF9", """
with c as (select distinct on (chunk_id) chunk_id, ts from (select cast(json_extract_string(props, '$.k') as bigint) chunk_id, ts from events where event_type = 'click') order by chunk_id, ts),
o as (select chunk_id, row_number() over (order by ts, chunk_id) ord from c)
select ord as position, doc_id, source from o join documents on doc_id = chunk_id""")
def ordered_id_list(spark, d):
    """Fetch the clicked chunks in the order of their first click."""
    first = X.clicks(spark, d).groupBy(F.col("chunk_id").alias("doc_id")).agg(F.min("ts").alias("first_ts"))
    wanted = filters.positions(first, ["first_ts", "doc_id"])
    return wanted.join(load(spark, d, "documents"), "doc_id").select("position", "doc_id", "source")


@query("slugify_titles", "ST1 SNK5 U7", f"""
with t as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) t from pages),
s as (select page_id, regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') s from t)
select page_id, s as slug, substring(s, 1, 80) as slug80, coalesce(nullif(substring(s, 1, 60), ''), 'untitled') as slug60 from s""")
def slugify_titles(spark, d):
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return load(spark, d, "pages").select(
        "page_id", text.slug(t).alias("slug"), text.slug(t, 80).alias("slug80"), text.slug(t, 60, "untitled").alias("slug60")
    )


@query("token_estimate", "ST3", "select doc_id, length(text) // 4 as tokens from documents")
def token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("squeeze_whitespace", "ST5", f"""
with p as (select page_id, list_transform(string_split(regexp_replace(html, '<[^>]*>', '', 'g'), chr(10)), lambda l: {S.strip('l')}) ls from pages),
q as (select page_id, list_filter(list_transform(flatten(list_transform(ls, lambda l: string_split(l, '  '))), lambda s: {S.strip('s')}), lambda s: s <> '') ps from p)
select page_id, array_to_string(ps, ' ') as body from q""")
def squeeze_whitespace(spark, d):
    return load(spark, d, "pages").select("page_id", text.squeeze_phrases(F.regexp_replace("html", "<[^>]*>", "")).alias("body"))


@query("sentence_counts", "ST6 ST7", f"""
select doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda s: {S.strip('s')}), lambda s: s <> '')) as bare_sentences,
 len(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as sentences,
 len(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n')) as paragraphs from documents""")
def sentence_counts(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id",
        F.size(text.bare_sentences(t)).cast("long").alias("bare_sentences"),
        F.size(text.sentences(t)).cast("long").alias("sentences"),
        F.size(F.split(F.replace(t, F.lit("\n"), F.lit("\n\n")), r"\n\s*\n")).cast("long").alias("paragraphs"),
    )


@query("endpoint_normalise", "ST16", """
with p as (select '/doc/' || event_id || '/user/' || md5(cast(user_id as varchar)) || '/job/' || substr(md5(event_type), 1, 8) || '-' || substr(md5(event_type), 9, 4)
  || '-' || substr(md5(event_type), 13, 4) || '-' || substr(md5(event_type), 17, 4) || '-' || substr(md5(event_type), 21, 12) path from events)
select regexp_replace(regexp_replace(regexp_replace(path, '/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '/{uuid}', 'g'),
  '/[0-9]+', '/{id}', 'g'), '/[a-f0-9]{32,}', '/{hash}', 'g') as endpoint, count(*) as n from p group by 1""")
def endpoint_normalise(spark, d):
    m = F.md5("event_type")
    uuid = F.concat_ws("-", *[F.substring(m, a, n) for a, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]])
    path = F.concat(F.lit("/doc/"), F.col("event_id").cast("string"), F.lit("/user/"), F.md5(F.col("user_id").cast("string")), F.lit("/job/"), uuid)
    return load(spark, d, "events").select(text.normalise_endpoint(path).alias("endpoint")).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


@query("query_variations", "ST15", """
select item_id, i - 1 as variant, [text, 'How to ' || text || '?', 'What is ' || text || '?', 'Where to find ' || text || '?',
  text || ' tutorial', text || ' example', text || ' setup'][i] as variation from benchmark cross join range(1, 8) r(i)""")
def query_variations(spark, d):
    return load(spark, d, "benchmark").select(
        "item_id", F.posexplode(text.query_variations(F.col("text"))).alias("variant", "variation")
    ).withColumn("variant", F.col("variant").cast("long"))


_NO_HEAD = "regexp_replace(html, '(?is)<head\\b.*?</head\\s*>', '')"


@query("trigram_similarity", "ST13 ST8", f"""
with p as (select page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) a, {S.visible_text(_NO_HEAD)} b from pages),
t as (select page_id, a, lower(b) b from p),
g as (select page_id, a, b, list_distinct(list_transform(range(1, greatest(length(a) - 1, 1)), lambda i: substring(a, i, 3))) ga,
  list_distinct(list_transform(range(1, greatest(length(b) - 1, 1)), lambda i: substring(b, i, 3))) gb from t)
select page_id, contains(b, a) as title_contained, round(case when len(list_distinct(ga || gb)) = 0 then 1.0 else len(list_intersect(ga, gb)) / len(list_distinct(ga || gb)) end, 6) as similarity,
  round(case when len(ga) = 0 then 1.0 else len(list_intersect(ga, gb)) / len(ga) end, 6) as title_share from g""")
def trigram_similarity(spark, d):
    """Each page's title against its whole visible text: trigrams in common, and the share of the title's found."""
    a = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    body = html.visible_text(F.regexp_replace("html", r"(?is)<head\b.*?</head\s*>", ""))
    texts = load_spread(spark, d, "pages", "page_id").select("page_id", a.alias("a"), body.alias("b"))
    grams = texts.withColumns({"ga": text.trigrams(F.col("a")), "gb": text.trigrams(F.col("b"))})
    shared = F.size(F.array_intersect("ga", "gb"))
    return grams.select(
        "page_id", F.contains(F.lower("b"), F.lower("a")).alias("title_contained"),
        F.round(text.jaccard(F.col("ga"), F.col("gb")), 6).alias("similarity"),
        F.round(F.when(F.size("ga") == 0, 1.0).otherwise(shared / F.size("ga")), 6).alias("title_share"),
    )


@query("result_lines", "ST17 Z23", """
select doc_id, '**' || source || '** [' || lang || '] ' || n_chars || ' chars' as line, 'metadata:' || doc_id as metadata_key,
 'analytics:' || lang || ':' || source as analytics_key, 'session:' || doc_id as session_key from documents""")
def result_lines(spark, d):
    i = F.col("doc_id").cast("string")
    return load(spark, d, "documents").select(
        "doc_id", F.format_string("**%s** [%s] %d chars", "source", "lang", "n_chars").alias("line"),
        ids.prefixed_key("metadata", i).alias("metadata_key"),
        ids.prefixed_key("analytics", F.col("lang"), F.col("source")).alias("analytics_key"),
        ids.prefixed_key("session", i).alias("session_key"),
    )


@query("content_hash", "H1 H2 H4", """
select doc_id, sha256(text) as content_hash, substr(sha256('https://docs.example.org/' || doc_id), 1, 16) as document_id,
 substr(sha256('https://docs.example.org/' || doc_id), 1, 16) || '_' || lpad(cast(n_chars % 10000 as varchar), 4, '0') as chunk_id from documents""")
def content_hash(spark, d):
    key = ids.url_id(F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string")))
    return load(spark, d, "documents").select(
        "doc_id", ids.content_hash(F.col("text")).alias("content_hash"), key.alias("document_id"),
        ids.numbered_chunk_id(key, F.col("n_chars") % 10000).alias("chunk_id"),
    )


@query("exact_duplicates", "H1 W9", """
select doc_id, min(doc_id) over (partition by sha256(text)) as first_doc, count(*) over (partition by sha256(text)) as copies
from documents qualify copies > 1""")
def exact_duplicates(spark, d):
    return filters.exact_copies(load(spark, d, "documents"), "doc_id", "text")


@query("stable_chunk_ids", "H3 H5 A1 A2 A3", """
with h as (select doc_id, text, list_filter([source, nullif(lang, 'en')], lambda x: x is not null) hp, n_chars from documents),
g as (select *, case when n_chars < 100 then [] else hp end p from h)
select doc_id, substr(md5(doc_id || '#' || case when len(p) > 0 then array_to_string(p, '|') else 'root' end || '#' || n_chars), 1, 12) as chunk_id,
 substr(sha256('doc/' || doc_id || '#' || array_to_string(p, ' > ') || '#' || substring(text, 1, 100)), 1, 16) as section_id,
 array_to_string(p, ' > ') as path, p[-1] as heading, len(p) as level, len(string_split('a > b' || array_to_string(p, ' > '), ' > ')) as parts from g""")
def stable_chunk_ids(spark, d):
    levels = F.array_compact(F.array("source", F.nullif("lang", F.lit("en"))))
    p = F.when(F.col("n_chars") < 100, F.array().cast("array<string>")).otherwise(levels)
    joined = F.array_join(p, " > ")
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return load(spark, d, "documents").select(
        "doc_id", ids.stable_chunk_id(F.col("doc_id").cast("string"), p, F.col("n_chars")).alias("chunk_id"),
        ids.section_id(url, joined, F.col("text")).alias("section_id"), joined.alias("path"),
        F.try_element_at(p, F.lit(-1)).alias("heading"), F.size(p).cast("long").alias("level"),
        F.size(F.split(F.concat(F.lit("a > b"), joined), " > ")).cast("long").alias("parts"),
    )


@query("lineage_ids", "H6 F1 Z27", f"""
with {X.CHUNKS_SQL}
select chunk_id, substr(md5(concat_ws('-', chunker_version, embedding_model, 'v1.0.0')), 1, 16) as run_id,
 md5(document_id || ':' || chunk_index || ':1.0:1.0') as chunk_lineage,
 sha256(coalesce(chunker_version, 'unknown') || '|' || coalesce(embedding_model, 'unknown') || '|' || document_id || '|' || chunk_index || '|unknown') as full_lineage from chunks""")
def lineage_ids(spark, d):
    doc = F.col("document_id").cast("string")
    return X.chunks(spark, d).select(
        "chunk_id", ids.run_lineage_id(F.col("chunker_version"), F.col("embedding_model"), F.lit("v1.0.0")).alias("run_id"),
        ids.chunk_lineage_id(doc, F.col("chunk_index"), F.lit("1.0"), F.lit("1.0")).alias("chunk_lineage"),
        ids.five_field_lineage_id(F.col("chunker_version"), F.col("embedding_model"), doc, F.col("chunk_index"), F.lit(None)).alias("full_lineage"),
    )


@query("cache_keys", "H7 Z23", """
select doc_id, 'search:' || md5('lang=' || lang || '&source=' || source || '|hybrid|' || regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')) as search_key,
 'embedding:default:' || sha256(text) as embedding_key from documents""")
def cache_keys(spark, d):
    one = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return load(spark, d, "documents").select(
        "doc_id", ids.search_cache_key(F.col("text"), one, F.lit("hybrid")).alias("search_key"),
        ids.embedding_cache_key(F.col("text"), F.lit("default")).alias("embedding_key"),
    )


@query("json_fields", "A4 A5 A7", """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.missing') as absent,
 '{"event_type":"' || event_type || '","user_id":' || user_id || '}' as doc, hex(encode(event_type)) as raw_hex from events""")
def json_fields(spark, d):
    ev = load(spark, d, "events").withColumn("m", F.from_json("props", "struct<k:bigint,missing:string>"))
    return ev.select(
        "event_id", F.col("m.k").alias("k"), F.col("m.missing").alias("absent"),
        F.to_json(F.struct("event_type", "user_id")).alias("doc"), F.hex(F.encode("event_type", "UTF-8")).alias("raw_hex"),
    )


@query("time_fields", "D1 D3 D4 D5", """
select event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') as http_date, epoch_us(ts) / 1e6 - epoch_us((select min(ts) from events)) / 1e6 as age_seconds,
 try_cast(case when event_type = 'error' then 'not a date' else replace(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'Z', '') end as timestamp) is not null as parsed,
 len(string_split(case when event_type = 'view' then '*/5 * * * *' else 'daily at noon' end, ' ')) = 5 as cron_ok from events""")
def time_fields(spark, d):
    ev = load(spark, d, "events")
    iso = F.when(F.col("event_type") == "error", F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    cron = F.when(F.col("event_type") == "view", F.lit("*/5 * * * *")).otherwise(F.lit("daily at noon"))
    micros = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    first = ev.agg(F.min("ts")).scalar()
    return ev.select(
        "event_id", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("http_date"),
        (micros(F.col("ts")) - micros(first)).alias("age_seconds"),
        F.try_to_timestamp(F.regexp_replace(iso, "Z$", "+00:00")).isNotNull().alias("parsed"),
        (F.size(F.split(cron, r"\s+")) == 5).alias("cron_ok"),
    )


@query("math_fields", "M3 M5 M8 M9", """
select event_id, least(0.5 * pow(2, user_id % 10), 60.0) as backoff, round(value / greatest(1, user_id), 10) as per_user,
 case when value < 1 then null else round((value - 1) / 1 * 100, 6) end as improvement from events""")
def math_fields(spark, d):
    v, u = F.col("value"), F.col("user_id")
    return load(spark, d, "events").select(
        "event_id", filters.retry_delay(u % 10, base=0.5).alias("backoff"),
        F.round(v / F.greatest(F.lit(1), u), 10).alias("per_user"),
        F.when(v >= 1, F.round((v - 1) / 1 * 100, 6)).alias("improvement"),
    )


@query("unit_vectors", "M3 M1", """
select vec_id, round(list_reduce(list_transform(embedding, lambda x: x::double * x), lambda a, b: a + b), 6) as squared_norm,
 round(embedding[1]::double / sqrt(list_reduce(list_transform(embedding, lambda x: x::double * x), lambda a, b: a + b)), 6) as first_unit from embeddings""")
def unit_vectors(spark, d):
    from folioscan.functions.vectors import norm, unit

    e = F.col("embedding")
    return load(spark, d, "embeddings").select(
        "vec_id", F.round(norm(e) * norm(e), 6).alias("squared_norm"), F.round(F.get(unit(e), F.lit(0)), 6).alias("first_unit")
    )
