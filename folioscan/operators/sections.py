"""Heading-aware views of Markdown and HTML texts, computed inside each row (no exchange)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import html, ids
from folioscan.functions.text import let, strip

STRINGS = "array<string>"


def empty_strings() -> Column:
    return F.array().cast(STRINGS)


def heading_list(lines: Column, stripped: bool = False) -> Column:
    """array<struct<line,level,text,offset>> of ATX headings in an array of lines.

    `line` is the 0-based line number and `offset` the character position of the line in the whole text.
    """
    numbered = F.transform(
        lines, lambda l, i: F.struct(i.alias("line"), (strip(l) if stripped else l).alias("s"))
    )
    found = F.filter(numbered, lambda x: x["s"].startswith("#") & x["s"].rlike(r"^#{1,6}\s+.+$"))
    return F.transform(
        found,
        lambda x: F.struct(
            x["line"].alias("line"),
            F.length(F.regexp_extract(x["s"], r"^(#{1,6})\s", 1)).alias("level"),
            strip(F.regexp_extract(x["s"], r"^#{1,6}\s+(.+)$", 1)).alias("text"),
            F.when(x["line"] == 0, 0)
            .otherwise(F.length(F.array_join(F.slice(lines, F.lit(1), x["line"]), "\n")) + 1)
            .alias("offset"),
        ),
    )


def heading_paths(headings: Column, root: list[str] | None = None, fill_gaps: bool = False) -> Column:
    """Breadcrumb of every heading: keep the first level-1 entries of the current path, then append.

    With fill_gaps, skipped levels are filled by empty entries; otherwise they are closed up.
    """
    start = F.array(*[F.lit(r) for r in root or []]).cast(STRINGS)
    zero = F.struct(start.alias("path"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        kept = F.slice(acc["path"], F.lit(1), h["level"] - 1)
        if fill_gaps:
            kept = F.concat(kept, F.array_repeat(F.lit(""), h["level"] - 1 - F.size(kept)))
        path = F.concat(kept, F.array(h["text"]))
        return F.struct(path.alias("path"), F.concat(acc["out"], F.array(path)).alias("out"))

    return F.aggregate(headings, zero, step, lambda acc: acc["out"])


def with_headings(docs: DataFrame, body: str, **path_options) -> DataFrame:
    stripped = path_options.pop("stripped", False)
    d = docs.withColumn("_lines", F.split(body, "\n")).withColumn("_heads", heading_list(F.col("_lines"), stripped))
    return d.withColumn("_paths", heading_paths(F.col("_heads"), **path_options))


def body_sections(
    docs: DataFrame, key: str, url: Column, body: str, root_name: str = "Document Root", root_path: list[str] | None = None
) -> DataFrame:
    """Text below each heading: (key, section_id, heading, content, content_hash, level, path, start_pos, end_pos).

    Text before the first heading belongs to the root section; blank sections are left out.
    """
    d = with_headings(docs, body, root=root_path)
    n = F.size("_lines")
    last = F.size("_heads")
    starts = F.concat(
        F.array(F.struct(F.lit(-1).alias("line"), F.lit(0).alias("level"), F.lit(root_name).alias("text"), F.lit(0).alias("offset"))),
        F.col("_heads"),
    )

    def section(h: Column, i: Column) -> Column:
        nxt = F.when(i < last, F.get(F.col("_heads"), i)["line"]).otherwise(n)
        end = F.when(i < last, F.get(F.col("_heads"), i)["offset"]).otherwise(F.length(body) + 1)
        inner = F.slice(F.col("_lines"), h["line"] + 2, nxt - h["line"] - 1)
        head_line = F.when(h["line"] >= 0, F.length(F.get(F.col("_lines"), h["line"])) + 1).otherwise(0)
        return F.struct(
            h["text"].alias("heading"), h["level"].alias("level"),
            F.concat(F.array_join(inner, "\n"), F.when(F.size(inner) > 0, "\n").otherwise("")).alias("raw"),
            F.when(i == 0, empty_strings()).otherwise(F.get(F.col("_paths"), i - 1)).alias("path"),
            (h["offset"] + head_line).alias("start_pos"), end.alias("end_pos"),
        )

    s = d.select(key, url.alias("_url"), F.inline(F.transform(starts, section))).filter(strip(F.col("raw")) != "")
    return s.select(
        key,
        ids.section_id(F.col("_url"), F.col("heading"), F.col("raw")).alias("section_id"),
        "heading", strip(F.col("raw")).alias("content"), ids.content_hash(F.col("raw")).alias("content_hash"),
        "level", F.array_join("path", " > ").alias("path"), "start_pos", "end_pos",
    )


def governing_heading(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line, heading): the latest heading at or before every line (as-of lookup within the row)."""
    d = with_headings(docs, body)
    lines = d.select(key, "_heads", F.posexplode("_lines").alias("line", "text"))
    before = F.filter("_heads", lambda h: h["line"] <= F.col("line"))
    return lines.select(key, "line", F.try_element_at(before, F.lit(-1))["text"].alias("heading"))


def html_section_array(page: Column) -> Column:
    """array<struct<heading,level,content>>: block texts of a page grouped under the preceding heading.

    Blocks are p, div and section elements; text outside of blocks (menus, lists) does not count, and text
    of nested blocks counts once.
    """
    marked = F.regexp_replace(html.drop_code(page), r"(?is)<(/?)(h[1-6]|p|div|section)\b[^>]*>", "\u0001$1$2\u0002")
    rest = let(F.split(marked, "\u0001"), lambda p: F.slice(p, F.lit(2), F.size(p)))
    parts = F.transform(
        rest,
        lambda p: F.struct(
            F.lower(F.split_part(p, F.lit("\u0002"), F.lit(1))).alias("tag"),
            strip(html.unescape(html.drop_tags(F.split_part(p, F.lit("\u0002"), F.lit(2))))).alias("text"),
        ),
    )
    kept = F.filter(
        parts, lambda p: p["tag"].rlike("^h[1-6]$") | ((p["text"] != "") & ~p["tag"].rlike("^/(div|section|h[1-6])$"))
    )
    shape = "struct<out:array<struct<heading:string,level:int,content:string>>,heading:string,level:int,cur:string>"
    zero = F.struct(F.array(), F.lit(None), F.lit(None), F.lit("")).cast(shape)

    def flush(acc: Column) -> Column:
        one = F.struct(acc["heading"].alias("heading"), acc["level"].alias("level"), acc["cur"].alias("content"))
        return F.when(acc["cur"] != "", F.concat(acc["out"], F.array(one))).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        def state(out: Column, heading: Column, level: Column, cur: Column) -> Column:
            return F.struct(out.alias("out"), heading.alias("heading"), level.alias("level"), cur.alias("cur")).cast(shape)

        headed = state(flush(acc), p["text"], F.substring(p["tag"], 2, 1).cast("int"), F.lit(""))
        joined = F.concat_ws(" ", F.nullif(acc["cur"], F.lit("")), p["text"])
        return F.when(p["tag"].rlike("^h[1-6]$"), headed).otherwise(state(acc["out"], acc["heading"], acc["level"], joined))

    return F.aggregate(kept, zero, step, flush)


def html_sections(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, pos, heading, level, content) rows of html_section_array."""
    found = html_section_array(F.col(page))
    return pages.select(key, F.posexplode(found).alias("pos", "s")).select(key, "pos", "s.heading", "s.level", "s.content")
