"""Crawl and content policy: robots rules, usage directives, licenses, fetch safety."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import urls
from folioscan.functions.text import matches_any, strip
from folioscan.operators.filters import url_pattern_verdict

# fixed values: directives that forbid machine use
NOAI_PATTERNS = [
    r"""<meta\s+name=["']robots["']\s+content=["'][^"'>]*noai[^"'>]*["']""",
    r"""<meta\s+name=["']googlebot["']\s+content=["'][^"'>]*noai[^"'>]*["']""",
    r"<!--\s*noai\s*-->",
    r"""data-noai=["']true["']""",
]
# fixed values: license wording by SPDX id, first match wins
LICENSE_PATTERNS = {
    "MIT": r"MIT\s+License|Permission\s+is\s+hereby\s+granted.*MIT",
    "Apache-2.0": r"Apache\s+License.*Version\s+2\.0",
    "GPL-3.0": r"GNU\s+General\s+Public\s+License.*version\s+3",
    "BSD-3-Clause": r"BSD\s+3-Clause|Redistribution\s+and\s+use.*BSD",
    "CC-BY-4.0": r"Creative\s+Commons.*Attribution\s+4\.0",
    "CC-BY-SA-4.0": r"Creative\s+Commons.*Attribution-ShareAlike\s+4\.0",
}
# fixed values: licenses that may be used
ALLOWED_LICENSES = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "ISC", "Unlicense", "0BSD"]
# fixed values: ports of internal services, hosts of instance metadata, names of the local host
BLOCKED_PORTS = [22, 23, 25, 53, 110, 143, 993, 995, 1433, 1521, 3306, 3389, 5432, 5984, 6379, 8086, 9200, 27017]
METADATA_HOSTS = ["metadata.google.internal", "169.254.169.254", "metadata.azure.com", "metadata.packet.net"]
LOCAL_NAMES = ["localhost", "0.0.0.0", "0", "local"]


def has_noai(content: Column, custom: list[str] | None = None) -> Column:
    return matches_any(content, [f"(?im){p}" for p in NOAI_PATTERNS + (custom or [])])


def detect_license(content: Column) -> Column:
    """First license whose wording occurs; a wording may not run across a line break where it says `.`."""
    found = None
    for name, pattern in LICENSE_PATTERNS.items():
        hit = content.rlike(f"(?im){pattern}")
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def effective_settings(docs: DataFrame, overrides: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Per-source settings: the source's override where it has one, else the default."""
    joined = docs.join(overrides, "source", "left")
    for name, value in defaults.items():
        fallback = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
        joined = joined.withColumn(name, F.coalesce(F.col(name), fallback))
    return joined


def content_verdict(docs: DataFrame, content: str) -> DataFrame:
    """Adds license, license_compatible, noai_compliant, compliant and the violations found.

    Needs the columns strict (boolean), respect_noai (boolean) and licenses (array). An unknown license
    passes; violations block only in strict mode.
    """
    c = F.col(content)
    noai = has_noai(c) & F.col("respect_noai")
    d = docs.withColumn("license", detect_license(c)).withColumn("_noai", noai)
    d = d.withColumn("license_compatible", F.col("license").isNull() | F.array_contains("licenses", F.col("license")))
    severity = F.when(F.col("strict"), "error").otherwise("warning")

    def violation(cond: Column, kind: str) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("type"), severity.alias("severity")))

    found = F.array(violation(F.col("_noai"), "noai_directive"), violation(~F.col("license_compatible"), "license_incompatible"))
    return (
        d.withColumn("noai_compliant", ~(F.col("_noai") & F.col("strict")))
        .withColumn("compliant", ~F.col("strict") | (~F.col("_noai") & F.col("license_compatible")))
        .withColumn("violations", F.filter(found, lambda v: v.isNotNull()))
        .drop("_noai")
    )


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """Rules that apply to `agent` per host from robots(host, status, body).

    (host, rules array<struct<allow,prefix>> in file order, crawl_delay). A named group wins over '*';
    404 means no rules, any other failure means everything is allowed.
    """
    text = F.regexp_replace(F.regexp_replace("body", r"\r", ""), r"#[^\n]*", "")
    groups = F.regexp_extract_all(
        text, F.lit(r"(?im)(?:^user-agent:[^\n]*(?:\n|\z))+(?:^(?!user-agent:)[^\n]+(?:\n|\z))*"), F.lit(0)
    )

    def agents(g: Column) -> Column:
        return F.transform(F.regexp_extract_all(g, F.lit(r"(?im)^user-agent:[ \t]*([^\n]*?)[ \t]*$"), F.lit(1)), F.lower)

    token = agent.lower().split("/")[0]
    named = F.filter(groups, lambda g: F.exists(agents(g), lambda a: (a != "*") & (a != "") & F.contains(F.lit(token), a)))
    starred = F.filter(groups, lambda g: F.exists(agents(g), lambda a: a == "*"))
    group = F.coalesce(F.get(named, F.lit(0)), F.get(starred, F.lit(0)), F.lit(""))
    lines = F.regexp_extract_all(group, F.lit(r"(?im)^(?:allow|disallow):[^\n]*$"), F.lit(0))
    rules = F.transform(
        lines,
        lambda l: F.struct(
            (F.lower(l).startswith("allow") | (strip(F.regexp_replace(l, "^[^:]*:", "")) == "")).alias("allow"),
            strip(F.regexp_replace(l, "^[^:]*:", "")).alias("prefix"),
        ),
    )
    delay = F.regexp_extract(group, r"(?im)^crawl-delay:[ \t]*([0-9]+)[ \t]*$", 1).try_cast("double")
    ok = F.col("status") == 200
    empty = F.array().cast("array<struct<allow:boolean,prefix:string>>")
    return robots.select("host", F.when(ok, rules).otherwise(empty).alias("rules"), F.when(ok, delay).alias("crawl_delay"))


def can_fetch(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds robots_allowed and crawl_delay: the first matching rule of the host decides, none allows."""
    joined = pages.withColumn("host", urls.netloc(F.col("url"))).join(rules, "host", "left")
    path = F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url")))
    first = F.get(F.filter("rules", lambda r: (r["prefix"] == "*") | path.startswith(r["prefix"])), F.lit(0))
    return joined.withColumn("robots_allowed", F.coalesce(first["allow"], F.lit(True)))


def url_verdict(checked: DataFrame, whitelist: list[str], blacklist: list[str]) -> DataFrame:
    """Overall fetch verdict: blacklist, then whitelist (skips robots), then robots rules."""
    verdict = url_pattern_verdict(F.col("url"), whitelist, blacklist)
    reason = F.when(verdict == "url_blacklisted", "url_blacklisted").when(
        (verdict == "check_robots") & ~F.col("robots_allowed"), "robots_disallow"
    )
    return checked.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def fetch_safety(candidates: DataFrame, url: str, resolved: str | None = None) -> DataFrame:
    """Adds reason (why a URL must not be fetched, null when it may) and safe_https.

    Host names are judged by the addresses in the array column `resolved` where it is given. Parts of the
    URL are columns of their own, so each is computed once per row.
    """
    u = F.col(url)
    d = candidates.withColumns({"_scheme": urls.scheme(u), "_host": urls.host(u), "_port": urls.port(u)})
    host = F.col("_host")
    d = d.withColumn("_literal", urls.is_ipv4(host) | host.rlike("^[0-9a-f:]*:[0-9a-f:.]*$"))
    d = d.withColumn("_private", F.col("_literal") & urls.is_private_address(host))
    reason = (
        F.when(~F.col("_scheme").isin("http", "https"), "scheme")
        .when(host == "", "no_host")
        .when(host.isin(LOCAL_NAMES), "localhost")
        .when(F.col("_port").isin(BLOCKED_PORTS), "port")
        .when(F.col("_private"), "private_address")
    )
    if resolved is not None:
        reason = reason.when(~F.col("_literal") & F.exists(resolved, lambda a: urls.is_private_address(a)), "resolves_private")
    metadata = F.exists(F.array(*[F.lit(m) for m in METADATA_HOSTS]), lambda m: F.contains(host, m))
    https = u.rlike(r"(?i)^https://[^/:]+(:[0-9]+)?(/|$)") & ~host.isin("169.254.169.254", "metadata", "metadata.google.internal")
    return d.withColumns(
        {"reason": reason.when(metadata, "metadata_host"), "safe_https": https & ~F.col("_private")}
    ).drop("_scheme", "_host", "_port", "_literal", "_private")
