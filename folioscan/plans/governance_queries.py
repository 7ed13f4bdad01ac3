"""Registered queries: policy, fetch safety and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import urls
from folioscan.operators import policy, validation
from folioscan.plans.registry import query
from folioscan.session import load, load_spread

# pages as they would arrive with usage directives: by language a meta tag, a comment or an attribute
_NOAI_SQL = """np as (select page_id, url, regexp_extract(html, '<html lang="([a-z]+)"', 1) lang,
  case regexp_extract(html, '<html lang="([a-z]+)"', 1) when 'de' then '<META name="robots" content="noai, nofollow">' || html when 'fr' then html || '<!-- noai -->'
  when 'es' then html || '<div data-noai=''true''>' else html end page from pages)"""


def _noai_pages(spark, d):
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    page = (
        F.when(lang == "de", F.concat(F.lit('<META name="robots" content="noai, nofollow">'), "html"))
        .when(lang == "fr", F.concat("html", F.lit("<!-- noai -->")))
        .when(lang == "es", F.concat("html", F.lit("<div data-noai='true'>"))).otherwise(F.col("html"))
    )
    return load(spark, d, "pages").select("page_id", "url", lang.alias("lang"), page.alias("page"))


@query("noai_check", "P2", f"with {_NOAI_SQL} select page_id, lang in ('de', 'fr', 'es') as noai from np")
def noai_check(spark, d):
    return _noai_pages(spark, d).select("page_id", policy.has_noai(F.col("page")).alias("noai"))


_LICENSE_SQL = """case when regexp_matches(text, '(?im)MIT\\s+License|Permission\\s+is\\s+hereby\\s+granted.*MIT') then 'MIT' when regexp_matches(text, '(?im)Apache\\s+License.*Version\\s+2\\.0') then 'Apache-2.0'
 when regexp_matches(text, '(?im)GNU\\s+General\\s+Public\\s+License.*version\\s+3') then 'GPL-3.0' when regexp_matches(text, '(?im)BSD\\s+3-Clause|Redistribution\\s+and\\s+use.*BSD') then 'BSD-3-Clause'
 when regexp_matches(text, '(?im)Creative\\s+Commons.*Attribution\\s+4\\.0') then 'CC-BY-4.0' when regexp_matches(text, '(?im)Creative\\s+Commons.*Attribution-ShareAlike\\s+4\\.0') then 'CC-BY-SA-4.0' end"""


@query("license_detect", "P3", f"select doc_id, {_LICENSE_SQL} as license from documents where {_LICENSE_SQL} is not null")
def license_detect(spark, d):
    return load(spark, d, "documents").select("doc_id", policy.detect_license(F.col("text")).alias("license")).filter("license is not null")


_POLICY_SQL = f"""o as (select source, bool_or(n_chars > 20000) or null strict, case when max(n_chars) > 25000 then ['MIT'] end licenses from documents group by 1),
p as (select doc_id, source, {_LICENSE_SQL} license, coalesce(strict, false) strict, coalesce(licenses, ['MIT', 'Apache-2.0', 'BSD-3-Clause']) licenses from documents left join o using (source)),
v as (select *, license is null or list_contains(licenses, license) ok from p)"""


def _policy(spark, d):
    docs = load_spread(spark, d, "documents", "doc_id")
    overrides = docs.groupBy("source").agg(F.max("n_chars").alias("m")).select(
        "source", F.when(F.col("m") > 20000, True).alias("strict"), F.when(F.col("m") > 25000, F.array(F.lit("MIT"))).alias("licenses"),
        F.lit(None).cast("boolean").alias("respect_noai"),
    )
    settings = policy.effective_settings(docs, overrides, {"strict": False, "licenses": ["MIT", "Apache-2.0", "BSD-3-Clause"], "respect_noai": True})
    return policy.content_verdict(settings, "text")


@query("license_policy_verdict", "P4 P5 Z9", f"""
with {_POLICY_SQL} select doc_id, license, strict, ok as license_compatible, not strict or ok as compliant from v""")
def license_policy_verdict(spark, d):
    return _policy(spark, d).select("doc_id", "license", "strict", "license_compatible", "compliant")


@query("policy_violations", "Z8 P5", f"""
with {_POLICY_SQL} select 'license_incompatible' as type, case when strict then 'error' else 'warning' end as severity, source, count(*) as n from v where not ok group by 2, 3""")
def policy_violations(spark, d):
    v = _policy(spark, d).select("source", F.inline("violations"))
    return v.groupBy("type", "severity", "source").agg(F.count(F.lit(1)).alias("n"))


# a robots file per host, written from the host's own pages: blog hosts answer 500, mobile hosts 404
_HOSTS_SQL = """h as (select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host, min(regexp_extract(url, '^[a-z]+://[^/?#]*(/[a-z]+/)', 1)) a,
  max(regexp_extract(url, '^[a-z]+://[^/?#]*(/[a-z]+/[0-9])', 1)) b from pages group by 1)"""


def _robots(spark, d):
    pages = load(spark, d, "pages").withColumn("host", urls.netloc(F.col("url")))
    path = urls.path(F.col("url"))
    h = pages.groupBy("host").agg(F.min(F.regexp_extract(path, "^(/[a-z]+/)", 1)).alias("a"), F.max(F.regexp_extract(path, "^(/[a-z]+/[0-9])", 1)).alias("b"))
    body = F.concat(
        F.lit("# rules\nUser-agent: otherbot\nDisallow: /\n\nUser-agent: *\nAllow: "), "b", F.lit("\nDisallow: "), "a",
        F.lit(" # section\nCrawl-delay: "), F.length("host").cast("string"), F.lit("\n"),
    )
    status = F.when(F.col("host").startswith("blog."), 500).when(F.col("host").startswith("m."), 404).otherwise(200)
    return h.select("host", status.alias("status"), body.alias("body"))


@query("robots_rules", "P1 J17 U4", f"""
with {_HOSTS_SQL}, p as (select page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') path from pages)
select page_id, case when host like 'blog.%' or host like 'm.%' then true when starts_with(path, b) then true when starts_with(path, a) then false else true end as robots_allowed,
 case when host like 'blog.%' or host like 'm.%' then null else length(host)::double end as crawl_delay from p join h using (host)""")
def robots_rules(spark, d):
    checked = policy.can_fetch(load(spark, d, "pages"), policy.robots_rules(_robots(spark, d), "folioscan/1.0"))
    return checked.select("page_id", "robots_allowed", "crawl_delay")


@query("url_policy_verdict", "P6 PF17 P1", f"""
with {_HOSTS_SQL}, p as (select page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') path from pages),
r as (select *, case when host like 'blog.%' or host like 'm.%' then true when starts_with(path, b) then true when starts_with(path, a) then false else true end ra from p join h using (host)),
q as (select page_id, case when regexp_matches(url, '(?i)\\.net/de/') then 'url_blacklisted' when not regexp_matches(url, '(?i)^https://www\\.') and not ra then 'robots_disallow' end reason from r)
select page_id, reason, reason is null as allowed from q""")
def url_policy_verdict(spark, d):
    checked = policy.can_fetch(load(spark, d, "pages"), policy.robots_rules(_robots(spark, d), "folioscan/1.0"))
    return policy.url_verdict(checked, [r"^https://www\."], [r"\.net/de/"]).select("page_id", "reason", "allowed")


# candidate URLs made from every page: its own address and forms that must be refused
_URL_FORMS = [
    ("url", "url", "own"), ("http://10.{o}.0.1/x", None, "own"), ("file:///etc/{i}", None, "own"), ("http://localhost/{i}", None, "own"),
    ("https://{h}:6379/", None, "own"), ("https://{h}:8443/ok", None, "own"), ("http://169.254.169.254/latest/{i}", None, "own"),
    ("http://metadata.google.internal/{i}", None, "own"), ("ftp://{h}/x", None, "own"), ("http:///nohost/{i}", None, "own"),
    ("http://172.{m}.1.1/", None, "own"), ("http://[::1]/{i}", None, "own"), ("http://[fd00::1]/{i}", None, "own"), ("https://8.8.8.8/{i}", None, "own"),
]
_REFUSED = {1: "private_address", 2: "scheme", 3: "localhost", 4: "port", 6: "private_address", 7: "metadata_host", 8: "scheme", 9: "no_host", 11: "private_address", 12: "private_address"}


def _candidates(spark, d):
    i = F.col("page_id").cast("string")
    parts = {"{o}": (F.col("page_id") % 256).cast("string"), "{i}": i, "{h}": urls.netloc(F.col("url")), "{m}": (F.col("page_id") % 40).cast("string")}

    def fill(form: str):
        out = F.lit(form)
        for mark, value in parts.items():
            out = F.replace(out, F.lit(mark), value)
        return out

    forms = [F.col("url")] + [fill(f[0]) for f in _URL_FORMS[1:]]
    return load(spark, d, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "candidate"))


@query("ssrf_verdict", "P7 U1 U8", f"""
select page_id, f::int as form, case f {' '.join(f"when {k} then '{v}'" for k, v in _REFUSED.items())} when 10 then case when page_id % 40 between 16 and 31 then 'private_address' end end as reason
from pages cross join range(0, {len(_URL_FORMS)}) r(f)""")
def ssrf_verdict(spark, d):
    return policy.fetch_safety(_candidates(spark, d), "candidate").select("page_id", "form", "reason")


@query("safe_https_url", "P8", """
select page_id, f::int as form, case f when 0 then url like 'https:%' when 4 then true when 5 then true when 13 then true else false end as safe from pages cross join range(0, 14) r(f)""")
def safe_https_url(spark, d):
    checked = policy.fetch_safety(_candidates(spark, d), "candidate")
    return checked.select("page_id", "form", F.col("safe_https").alias("safe"))


@query("validate_documents", "P10 Z10", """
with s as (select doc_id n, case when lang = 'fr' then 'doc ' || doc_id when lang = 'es' and n_chars < 300 then '' else 'doc-' || doc_id end doc_id, string_split(text, chr(10))[1] title,
  case source when 'src4' then 'not a url' else 'https://docs.example.org/' || source end url, text content,
  case when n_chars > 3000 then list_transform(range(0, 60), lambda i: 'tag') else [source, lang || case when lang = 'de' then '!' else '' end] end tags, 1000 - n_chars file_size from documents),
e as (select n, unnest(list_filter([case when doc_id = '' then 'doc_id_empty' end, case when doc_id <> '' and not regexp_matches(doc_id, '^[a-zA-Z0-9._-]+$') then 'doc_id_characters' end,
  case when title = '' then 'title_empty' end, case when length(title) > 500 then 'title_long' end, case when url = 'not a url' then 'url_format' end,
  case when len(tags) > 50 then 'tags_many' end, case when list_contains(tags, 'de!') then 'tag_characters' end, case when file_size < 0 then 'file_size_negative' end], lambda x: x is not null)) code from s)
select n as doc_id, code from e""")
def validate_documents(spark, d):
    docs = load(spark, d, "documents")
    i, n, lang = F.col("doc_id").cast("string"), F.col("n_chars"), F.col("lang")
    rows = docs.select(
        F.col("doc_id").alias("n"),
        F.when(lang == "fr", F.concat(F.lit("doc "), i)).when((lang == "es") & (n < 300), "").otherwise(F.concat(F.lit("doc-"), i)).alias("doc_id"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
        F.when(F.col("source") == "src4", "not a url").otherwise(F.concat(F.lit("https://docs.example.org/"), "source")).alias("url"),
        F.col("text").alias("content"),
        F.when(n > 3000, F.array_repeat(F.lit("tag"), 60)).otherwise(F.array("source", F.concat("lang", F.when(lang == "de", "!").otherwise("")))).alias("tags"),
        F.array("lang").alias("categories"), (1000 - n).alias("file_size"),
    )
    bad = rows.select(F.col("n").alias("doc_id"), F.explode(validation.document_errors(F.lit("text"))).alias("code"))
    return bad


# one source configuration per page as JSON text, its settings taken from the page's own numbers
def _configs(spark, d):
    p, size = F.col("page_id"), F.length("html")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    i = p.cast("string")
    name = F.when(size % 7 == 0, text(F.lit("  "))).when(size % 7 == 1, i).when(size % 7 == 2, text(F.repeat(F.lit("n"), 120))).otherwise(text(F.concat(F.lit("source "), i)))
    base = F.when(size % 5 == 0, F.lit("[]")).when(size % 5 == 1, F.concat(F.lit("[7,"), text(F.lit("nowhere")), F.lit("]"))).otherwise(F.concat(F.lit("["), text(F.col("url")), F.lit("]")))
    auth = (
        F.when(size % 6 == 0, F.lit('{"type":"basic","password":"x"}')).when(size % 6 == 1, F.lit('{"type":"bearer"}'))
        .when(size % 6 == 2, F.lit('{"type":"api_key","key":"k"}')).when(size % 6 == 3, F.lit('{"token":"t"}')).otherwise(F.lit("{}"))
    )
    parts = F.array(
        F.when(size % 11 != 0, field("name", name)),
        field("base_urls", base),
        field("schema_version", text(F.when(size % 3 == 0, "1.0").when(size % 3 == 1, "1.2").otherwise("9.9"))),
        field("rate_limit", F.when(size % 13 == 0, text(F.lit("fast"))).otherwise(((size % 120) - 5).cast("string"))),
        field("depth", ((size % 16) - 2).cast("string")),
        field("priority", (size % 14).cast("string")),
        field("timeout", ((size % 400) - 10).cast("string")),
        F.when(size % 4 == 0, field("include", F.lit('["/a/","/b/"]'))),
        F.when(size % 4 < 2, field("exclude", F.lit('["/b/",3]'))),
        field("auth", auth),
        F.when(size % 9 == 0, field("colour", text(F.lit("red")))),
        F.when(size % 2 == 0, field("sitemaps", F.concat(F.lit("["), text(F.concat("url", F.lit(" x"))), F.lit("]")))),
    )
    return load(spark, d, "pages").select("page_id", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("config"))


_ISSUES_SQL = """c as (select page_id, url, length(html) z from pages),
f as (select *, z % 3 = 1 v12, z % 5 = 0 eb, z % 5 = 1 bb, z % 13 <> 0 rok, ((z % 120) - 5)::double rate, ((z % 16) - 2)::double depth, z % 14 prio, ((z % 400) - 10)::double tmo from c),
i as (select page_id, unnest([
 {'code': 'UNSUPPORTED_SCHEMA', 'n': (z % 3 = 2)::bigint}, {'code': 'MISSING_REQUIRED_FIELD', 'n': (z % 11 = 0)::bigint},
 {'code': 'INVALID_FIELD_TYPE', 'n': (z % 11 <> 0 and z % 7 = 1)::bigint + (not rok)::bigint},
 {'code': 'UNKNOWN_FIELD', 'n': (z % 9 = 0)::bigint + (not v12)::bigint}, {'code': 'EMPTY_NAME', 'n': (z % 11 <> 0 and z % 7 = 0)::bigint}, {'code': 'NAME_TOO_LONG', 'n': (z % 11 <> 0 and z % 7 = 2)::bigint},
 {'code': 'EMPTY_BASE_URLS', 'n': eb::bigint}, {'code': 'INVALID_URL_TYPE', 'n': bb::bigint}, {'code': 'INVALID_URL_FORMAT', 'n': bb::bigint}, {'code': 'MISSING_DOMAIN', 'n': bb::bigint},
 {'code': 'INVALID_SITEMAP_URL', 'n': (z % 2 = 0)::bigint}, {'code': 'INVALID_PATTERN_TYPE', 'n': (z % 4 < 2)::bigint},
 {'code': 'INVALID_RATE_LIMIT', 'n': (rok and rate <= 0)::bigint}, {'code': 'HIGH_RATE_LIMIT', 'n': (rok and rate > 100)::bigint},
 {'code': 'NEGATIVE_DEPTH', 'n': (depth < 0)::bigint}, {'code': 'DEEP_CRAWL', 'n': (depth > 10)::bigint}, {'code': 'INVALID_PRIORITY', 'n': (prio not between 1 and 10)::bigint},
 {'code': 'INVALID_TIMEOUT', 'n': (v12 and tmo <= 0)::bigint}, {'code': 'LONG_TIMEOUT', 'n': (v12 and tmo > 300)::bigint}, {'code': 'CONFLICTING_PATTERNS', 'n': (z % 4 = 0)::bigint},
 {'code': 'MISSING_AUTH_TYPE', 'n': (z % 6 = 3)::bigint}, {'code': 'INCOMPLETE_BASIC_AUTH', 'n': (z % 6 = 0)::bigint}, {'code': 'MISSING_BEARER_TOKEN', 'n': (z % 6 = 1)::bigint}, {'code': 'INCOMPLETE_API_KEY_AUTH', 'n': (z % 6 = 2)::bigint},
 {'code': 'LONG_CRAWL_TIME', 'n': coalesce((case when eb then 0 when bb then 2 else 1 end) * pow(10, least(depth, 3)) / nullif(case when rok then rate else 1.0 end, 0) / 3600 > 24, false)::bigint},
 {'code': 'RESOURCE_INTENSIVE', 'n': (depth > 5 and rok and rate > 10)::bigint}, {'code': 'INSECURE_URL', 'n': (not eb and not bb and url like 'http://%')::bigint}, {'code': 'PLAINTEXT_PASSWORD', 'n': (z % 6 = 0)::bigint}
 ], recursive := true) from f),
w as (select page_id, code, case when code in ('UNKNOWN_FIELD', 'NAME_TOO_LONG', 'HIGH_RATE_LIMIT', 'DEEP_CRAWL', 'LONG_TIMEOUT', 'CONFLICTING_PATTERNS', 'LONG_CRAWL_TIME', 'RESOURCE_INTENSIVE', 'INSECURE_URL', 'PLAINTEXT_PASSWORD')
  then 'warning' else 'error' end severity, n from i where n > 0)"""


@query("validate_sources", "P11 P12 P13 P14 P16 Z11 SRC8", f"with {_ISSUES_SQL} select page_id, code, severity, n from w")
def validate_sources(spark, d):
    return validation.source_issues(_configs(spark, d), "page_id", "config")


@query("validation_summary", "P15 Z11", f"""
with {_ISSUES_SQL}, p as (select page_id, coalesce(sum(n) filter (severity = 'error'), 0) e, coalesce(sum(n) filter (severity = 'warning'), 0) g from pages left join w using (page_id) group by 1)
select count(*) as total, sum((e = 0)::int)::bigint as valid, sum((e > 0)::int)::bigint as invalid, sum(e)::bigint as errors, sum(g)::bigint as warnings from p""")
def validation_summary(spark, d):
    c = _configs(spark, d)
    return validation.roll_up(c, validation.source_issues(c, "page_id", "config"), "page_id")


@query("invalid_regex", "P11", """
select page_id, p as pattern, 'INVALID_REGEX' as code from (select page_id, unnest(['/' || length(html) || '/', '[' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)]) p from pages) where p like '[%'""")
def invalid_regex(spark, d):
    p = F.array(F.concat(F.lit("/"), F.length("html").cast("string"), F.lit("/")), F.concat(F.lit("["), urls.netloc(F.col("url"))))
    return validation.invalid_patterns(load(spark, d, "pages").select("page_id", p.alias("patterns")), "page_id", "patterns")
