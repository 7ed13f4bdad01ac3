"""Regular-expression views of HTML pages."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.text import let, squeeze_phrases, strip

def unescape(text: Column) -> Column:
    """Decimal, hexadecimal and named character references as characters; a non-breaking space becomes a blank.

    Each piece from one "&" to the next begins with at most one reference, so nothing is decoded twice. Unknown
    names and impossible numbers stay as they are.
    """
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, code)], F.lit("apos"), F.lit(39))

    def one(piece: Column) -> Column:
        def number(ref: Column) -> Column:
            return (
                F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 6), 16, 10).try_cast("int"))
                .when(ref.startswith("#"), F.substring(ref, 2, 7).try_cast("int")).otherwise(F.try_element_at(names, ref))
            )

        def decoded(code: Column) -> Column:
            sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
            char = F.when(code == 160, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))
            return F.when(sound, F.concat(char, F.regexp_replace(piece, "^&[^;]*;", ""))).otherwise(piece)

        ref = F.regexp_extract(piece, r"^&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        return F.when(piece.startswith("&"), let(let(ref, number), decoded)).otherwise(piece)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), one), "")).otherwise(text)


def drop_code(html: Column) -> Column:
    """Remove script and style elements and comments with their content."""
    out = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    out = F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style\s*>", "")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", "")


def drop_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def visible_text(html: Column) -> Column:
    return squeeze_phrases(unescape(drop_tags(drop_code(html))))


def hrefs(html: Column) -> Column:
    """Link targets in order: double-quoted, single-quoted or bare values, character references decoded."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    return F.transform(raw, lambda v: unescape(F.regexp_replace(v, "^[\"']|[\"']$", "")))


def title(html: Column) -> Column:
    return strip(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def headings(html: Column) -> Column:
    """array<struct<level,text>> of h1..h6 in document order, empty ones skipped."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>"), F.lit(0))
    shaped = F.transform(
        raw,
        lambda h: F.struct(
            F.substring(h, 3, 1).cast("int").alias("level"),
            strip(unescape(drop_tags(h))).alias("text"),
        ),
    )
    return F.filter(shaped, lambda h: h["text"] != "")


def markdown(html: Column) -> Column:
    """Readable Markdown: headings, list items, links, emphasis and paragraphs; navigation removed."""
    out = drop_code(html)
    for tag in ("nav", "head", "footer", "aside"):  # one kind after the other, also where they overlap
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    for level in range(1, 7):
        out = F.regexp_replace(
            out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n"
        )
    out = F.regexp_replace(out, r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a\s*>', "[$2]($1)")
    out = F.regexp_replace(out, r"(?is)</?(b|strong)\b[^>]*>", "**")
    out = F.regexp_replace(out, r"(?is)</?(i|em)\b[^>]*>", "*")
    out = F.regexp_replace(out, r"(?is)<li\b[^>]*>", "\n- ")
    out = F.regexp_replace(out, r"(?is)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?is)</?(p|div|section|article|ul|ol|table|tr|blockquote)\b[^>]*>", "\n\n")
    out = unescape(drop_tags(out))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def feed_items(xml: Column) -> Column:
    """array<struct<title,link>> of the items or entries of an RSS / Atom feed."""
    raw = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)\b[^>]*>.*?</(?:item|entry)>"), F.lit(0))
    return F.transform(
        raw,
        lambda e: F.struct(
            strip(unescape(F.regexp_extract(e, r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("title"),
            F.coalesce(
                F.nullif(F.regexp_extract(e, r"(?is)<link[^>]*>([^<]+)</link>", 1), F.lit("")),
                F.regexp_extract(e, r'(?is)<link[^>]*href="([^"]*)"', 1),
            ).alias("link"),
        ),
    )


def sitemap_locations(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
