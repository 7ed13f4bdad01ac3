"""String expressions: tokenising, slugs, whitespace, previews, set similarity."""

from __future__ import annotations

import re

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
# Latin letters that are a base letter with one mark or more, by their canonical decomposition
_ACCENTED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and c == c.lower()}
ACCENTED, PLAIN = "".join(_ACCENTED), "".join(_ACCENTED.values())
TOKEN_BREAK = "[^a-z0-9]+"
EDGE_SPACE = " \t\n\f\r"


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row instead of at every use inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.octet_length(low) > F.length(low), F.translate(low, ACCENTED, PLAIN)).otherwise(low)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case, Latin accents folded (unstemmed); texts are taken as composed."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(folded(text), F.lit(TOKEN))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def strip(text: Column) -> Column:
    """All leading and trailing whitespace, not only blanks."""
    return F.trim(text, F.lit(EDGE_SPACE))


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity of two arrays without repeats; two empty sets are equal, one empty set matches nothing."""

    def ratio(s: Column) -> Column:
        either = s["n"] - s["both"]
        return F.when(either == 0, F.lit(1.0)).otherwise(s["both"] / either)

    both = F.size(F.array_intersect(left, right)).alias("both")
    return let(F.struct(both, (F.size(left) + F.size(right)).alias("n")), ratio)


def slug(text: Column, width: int | None = None, default: str | None = None) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), TOKEN_BREAK, "-"), "^-+|-+$", "")
    if width is not None:
        out = F.substring(out, 1, width)
    if default is not None:
        out = F.coalesce(F.nullif(out, F.lit("")), F.lit(default))
    return out


def url_path_slug(path: Column) -> Column:
    """Relative Markdown file name for a URL path."""
    whole = F.when(path.endswith("/"), F.concat(path, F.lit("index"))).otherwise(path)
    safe = F.regexp_replace(F.regexp_replace(whole, "[^a-zA-Z0-9/_-]", "-"), "^/+|/+$", "")
    return F.concat(F.when(safe == "", F.lit("index")).otherwise(safe), F.lit(".md"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def squeeze_phrases(text: Column) -> Column:
    """Strip each line, split it on double blanks, join the non-empty phrases by one blank."""
    lines = F.transform(F.split(text, "\n"), strip)
    phrases = F.flatten(F.transform(lines, lambda line: F.split(line, "  ")))
    return F.array_join(F.filter(F.transform(phrases, strip), lambda p: p != ""), " ")


def sentences(text: Column) -> Column:
    """Sentences with their terminator; the blank comes first in the pattern, because looking back at every character is slow."""
    return F.split(text, r"\s(?<=[.!?]\s)\s*")


def bare_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+\s+"), strip), lambda s: s != "")


def preview(text: Column, width: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit(tail))).otherwise(text)


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of the lower-cased text; characters are split once, so long texts stay linear."""

    def cut(chars: Column) -> Column:
        window = lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2))
        return F.array_distinct(F.filter(F.transform(chars, window), lambda w: w.isNotNull()))

    return let(F.split(F.lower(text), "(?s)(?<=.)(?=.)"), cut)


def query_variations(base: Column) -> Column:
    """The base query plus question and usage phrasings."""
    # fixed values
    phrasings = ["{}", "How to {}?", "What is {}?", "Where to find {}?", "{} tutorial", "{} example", "{} setup"]
    return F.array(*[F.concat(F.lit(before), base, F.lit(after)) for before, after in (p.split("{}") for p in phrasings)])


def normalise_endpoint(path: Column) -> Column:
    """Replace identifiers in a request path by placeholders: uuids, then numbers, then long hex."""
    # fixed values
    rules = [
        ("/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "/{uuid}"),
        ("/[0-9]+", "/{id}"),
        ("/[a-f0-9]{32,}", "/{hash}"),
    ]
    for pattern, placeholder in rules:
        path = F.regexp_replace(path, pattern, placeholder)
    return path


def glob_regex(pattern: str) -> str:
    """Whole-string regex for a shell glob (* crosses slashes, ? is one character)."""
    parts = re.split(r"(\*+|\?)", pattern)
    out = "".join(".*" if p.startswith("*") else "." if p == "?" else re.escape(p) for p in parts)
    return f"(?s)^{out}$"


def matches_any(text: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def keyword_tokens(text: Column) -> Column:
    """Whole words of three or more ASCII letters, lower-cased, without common words."""
    # fixed values
    common = ["the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "has", "have", "this", "that", "with", "will"]
    runs = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(runs, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(common))
