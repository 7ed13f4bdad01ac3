"""Validation of source documents and source configurations as arrays of failed rule codes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
URL_PATTERN = (
    r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|localhost|"
    r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?::[0-9]+)?(?:/?|[/?]\S+)$"
)
NAME_PATTERN = "^[a-zA-Z0-9._-]+$"
MAX_CONTENT = {
    "markdown": 10_000_000, "html": 10_000_000, "text": 10_000_000, "pdf": 50_000_000, "docx": 10_000_000,
    "confluence": 5_000_000, "notion": 5_000_000, "github": 1_000_000, "web": 5_000_000,
}
VERSIONS = ["1.0", "1.1", "1.2"]
# fixed values: field -> (JSON type, first schema version that knows it)
FIELDS = {
    "name": ("string", "1.0"), "base_urls": ("array", "1.0"), "sitemaps": ("array", "1.0"), "include": ("array", "1.0"),
    "exclude": ("array", "1.0"), "rate_limit": ("number", "1.0"), "depth": ("integer", "1.0"), "priority": ("integer", "1.0"),
    "auth": ("object", "1.0"), "license_hint": ("string", "1.0"), "headers": ("object", "1.1"), "timeout": ("number", "1.1"),
    "retry_config": ("object", "1.2"), "content_filters": ("object", "1.2"),
}
REQUIRED = ["name", "base_urls"]
WARNINGS = [
    "UNKNOWN_FIELD", "NAME_TOO_LONG", "HIGH_RATE_LIMIT", "DEEP_CRAWL", "LONG_TIMEOUT", "CONFLICTING_PATTERNS", "LONG_CRAWL_TIME",
    "RESOURCE_INTENSIVE", "INSECURE_URL", "PLAINTEXT_PASSWORD",
]


def _codes(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules whose condition holds (unknown counts as not failed)."""
    return F.array_compact(F.array(*[F.when(cond, code) for cond, code in rules]))


def document_errors(kind: Column) -> Column:
    """Failed rules of a source document row (doc_id, title, url, content, tags, categories, file_size)."""
    c = F.col
    length_limit = F.lit(1_000_000)
    for name, size in MAX_CONTENT.items():
        length_limit = F.when(kind == name, size).otherwise(length_limit)
    return _codes(
        (c("doc_id").isNull() | (c("doc_id") == ""), "doc_id_empty"),
        (F.length("doc_id") > 255, "doc_id_long"),
        ((c("doc_id") != "") & ~c("doc_id").rlike(NAME_PATTERN), "doc_id_characters"),
        (c("title").isNull() | (c("title") == ""), "title_empty"),
        (F.length("title") > 500, "title_long"),
        (F.length("url") > 2048, "url_long"),
        (~c("url").rlike(URL_PATTERN), "url_format"),
        (c("content").isNull() | (F.length("content") == 0), "content_empty"),
        (F.length("content") > length_limit, "content_long"),
        (F.size("tags") > 50, "tags_many"),
        (F.exists("tags", lambda t: F.length(t) > 100), "tag_long"),
        (F.exists("tags", lambda t: ~t.rlike(NAME_PATTERN)), "tag_characters"),
        (F.size("categories") > 20, "categories_many"),
        (F.exists("categories", lambda t: F.length(t) > 100), "category_long"),
        (~kind.isin(list(MAX_CONTENT)), "source_type"),
        (c("file_size") < 0, "file_size_negative"),
    )


def _kind(shape: Column) -> Column:
    """JSON kind from a variant's schema, null when the field is absent."""
    return (
        F.when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object")
        .when(shape == "STRING", "string").when(shape == "BIGINT", "integer").when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null").when(shape.isNotNull(), "number")
    )


def source_issues(configs: DataFrame, key: str, config: str) -> DataFrame:
    """(key, code, severity, n) for every failed rule of source configurations held as JSON text.

    Types are read from the JSON itself (variant), so wrong types and unknown fields are seen. Values are
    taken out in stages, one column each, so that no rule repeats the extraction.
    """
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    c = F.col
    d = configs.select(key, F.col(config).alias("_json"), F.try_parse_json(config).alias("v"))
    d = d.withColumns({f"s_{f}": F.schema_of_variant(get(f, "variant")) for f in FIELDS})
    d = d.withColumns({f"k_{f}": _kind(c(f"s_{f}")) for f in FIELDS})
    version = F.coalesce(get("schema_version", "string"), F.lit("1.0"))
    d = d.withColumn("asked", version).withColumn("ver", F.when(c("asked").isin(VERSIONS), c("asked")).otherwise("1.0"))

    def good(f: str) -> Column:
        kinds = [FIELDS[f][0]] + (["integer"] if FIELDS[f][0] == "number" else [])
        return c(f"k_{f}").isin(kinds)

    known = lambda f: F.lit(FIELDS[f][1]) <= c("ver")
    lists = ("base_urls", "sitemaps", "include", "exclude")
    d = d.withColumns(
        {
            **{f"n_{f}": F.when(good(f) & known(f), get(f, "double")) for f in ("rate_limit", "depth", "priority", "timeout")},
            **{f"i_{f}": F.when(good(f), get(f, "array<variant>")) for f in lists},
            "name": F.when(good("name"), get("name", "string")),
            "auth": good("auth") & (F.size(F.json_object_keys(get("auth", "string"))) > 0),
            "auth_type": get("auth.type", "string"),
            "names": F.json_object_keys("_json"),
            **{f"a_{p}": get(f"auth.{p}", "variant").isNotNull() for p in ("type", "username", "password", "token", "key", "header")},
        }
    )
    d = d.withColumns(
        {
            f"t_{f}": F.transform(
                F.filter(f"i_{f}", lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")
            )
            for f in lists
        }
    )
    non_text = lambda f: F.size(f"i_{f}") - F.size(f"t_{f}")
    bad_urls = lambda f: F.size(F.filter(f"t_{f}", lambda u: ~u.rlike(URL_PATTERN)))
    rate, depth, timeout, auth, kind = c("n_rate_limit"), c("n_depth"), c("n_timeout"), c("auth"), c("auth_type")
    later = [f for f in FIELDS if FIELDS[f][1] != "1.0"]
    unknown = F.size(F.filter("names", lambda f: ~f.isin("schema_version", *FIELDS)))
    pages = F.coalesce(F.size("i_base_urls"), F.lit(0)) * F.pow(F.lit(10.0), F.least(F.coalesce(depth, F.lit(3.0)), F.lit(3.0)))
    hours = F.try_divide(pages, F.coalesce(rate, F.lit(1.0))) / 3600
    one = lambda cond: F.when(cond, 1).otherwise(0)
    total = lambda conds: sum((one(x) for x in conds), F.lit(0))
    counts = {
        "UNSUPPORTED_SCHEMA": one(~c("asked").isin(VERSIONS)),
        "MISSING_REQUIRED_FIELD": total(c(f"k_{f}").isNull() for f in REQUIRED),
        "INVALID_FIELD_TYPE": total(c(f"k_{f}").isNotNull() & known(f) & ~good(f) for f in FIELDS),
        "UNKNOWN_FIELD": unknown + total(c(f"k_{f}").isNotNull() & ~known(f) for f in later),
        "EMPTY_NAME": one(F.regexp_replace("name", r"\s", "") == ""),
        "NAME_TOO_LONG": one(F.length("name") > 100),
        "EMPTY_BASE_URLS": one(F.size("i_base_urls") == 0),
        "INVALID_URL_TYPE": non_text("base_urls"),
        "INVALID_URL_FORMAT": bad_urls("base_urls"),
        "MISSING_DOMAIN": F.size(F.filter("t_base_urls", lambda u: ~u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"))),
        "INVALID_SITEMAP_TYPE": non_text("sitemaps"),
        "INVALID_SITEMAP_URL": bad_urls("sitemaps"),
        "INVALID_PATTERN_TYPE": F.coalesce(non_text("include"), F.lit(0)) + F.coalesce(non_text("exclude"), F.lit(0)),
        "INVALID_RATE_LIMIT": one(rate <= 0),
        "HIGH_RATE_LIMIT": one(rate > 100),
        "NEGATIVE_DEPTH": one(depth < 0),
        "DEEP_CRAWL": one(depth > 10),
        "INVALID_PRIORITY": one(~c("n_priority").between(1, 10)),
        "INVALID_TIMEOUT": one(timeout <= 0),
        "LONG_TIMEOUT": one(timeout > 300),
        "CONFLICTING_PATTERNS": F.size(F.array_intersect("t_include", "t_exclude")),
        "MISSING_AUTH_TYPE": one(auth & ~c("a_type")),
        "INCOMPLETE_BASIC_AUTH": one(auth & (kind == "basic") & ~(c("a_username") & c("a_password"))),
        "MISSING_BEARER_TOKEN": one(auth & (kind == "bearer") & ~c("a_token")),
        "INCOMPLETE_API_KEY_AUTH": one(auth & (kind == "api_key") & ~(c("a_key") & c("a_header"))),
        "LONG_CRAWL_TIME": one(hours > 24),
        "RESOURCE_INTENSIVE": one((depth > 5) & (rate > 10)),
        "INSECURE_URL": F.size(F.filter("t_base_urls", lambda u: u.startswith("http://"))),
        "PLAINTEXT_PASSWORD": one(auth & c("a_password")),
    }
    cells = F.array(
        *[
            F.struct(
                F.lit(code).alias("code"), F.lit("warning" if code in WARNINGS else "error").alias("severity"),
                F.coalesce(n, F.lit(0)).cast("long").alias("n"),
            )
            for code, n in counts.items()
        ]
    )
    return d.select(key, F.inline(F.filter(cells, lambda x: x["n"] > 0)))


@F.pandas_udf(T.BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    """Whether each text is a valid regular expression."""

    def ok(pattern: str) -> bool:
        try:
            re.compile(pattern)
            return True
        except re.error:
            return False

    return patterns.map(ok)


def invalid_patterns(configs: DataFrame, key: str, patterns: str) -> DataFrame:
    """Patterns that are not valid regular expressions (each distinct pattern is compiled once)."""
    flat = configs.select(key, F.explode(patterns).alias("pattern"))
    bad = flat.select("pattern").distinct().filter(~compiles(F.col("pattern")))
    return flat.join(bad, "pattern", "left_semi").select(key, "pattern", F.lit("INVALID_REGEX").alias("code"))


def roll_up(configs: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """One row: files, valid files, errors, warnings."""
    per = issues.groupBy(key).agg(
        F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warnings"),
    )
    j = configs.select(key).join(per, key, "left")
    e, w = F.coalesce("errors", F.lit(0)), F.coalesce("warnings", F.lit(0))
    return j.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(e == 0).alias("valid"), F.count_if(e > 0).alias("invalid"),
        F.sum(e).alias("errors"), F.sum(w).alias("warnings"),
    )
