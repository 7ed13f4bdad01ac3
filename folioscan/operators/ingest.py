"""Turning scanned pages and Markdown files into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import html, ids, text, urls


def ingest_pages(pages: DataFrame, min_markdown: int = 40) -> DataFrame:
    """Pages to Markdown documents; very short Markdown falls back to the page's plain text."""
    md = html.markdown(F.col("html"))
    return pages.withColumn("_md", md).select(
        "page_id", "url",
        ids.url_id(F.col("url")).alias("doc_id"),
        html.title(F.col("html")).alias("title"),
        text.url_path_slug(urls.path(F.col("url"))).alias("file"),
        F.when(F.length("_md") < min_markdown, html.visible_text(F.col("html"))).otherwise(F.col("_md")).alias("body"),
    )


def parse_markdown(files: DataFrame, path: str = "path", body: str = "text") -> DataFrame:
    """Title, front matter map and remaining text of Markdown files.

    The title is the first level-one heading, else the file stem; front matter is a leading --- block of
    `key: value` lines, split on the first colon, with quotes removed.
    """
    t = F.col(body)
    heading = text.strip(F.regexp_extract(t, r"(?m)^#[ \t]+(.+)$", 1))
    stem = F.regexp_replace(F.regexp_extract(F.col(path), r"([^/]*)$", 1), r"\.[^.]*$", "")
    head = F.regexp_extract(t, r"(?s)^---(.*?)---", 1)
    pairs = F.filter(F.split(text.strip(head), "\n"), lambda line: line.contains(":"))

    def pair(line: Column) -> Column:
        value = text.strip(F.regexp_replace(line, "^[^:]*:", ""))
        return F.struct(
            text.strip(F.regexp_extract(line, "^([^:]*):", 1)).alias("key"),
            F.regexp_replace(value, "^['\"]+|['\"]+$", "").alias("value"),
        )

    rest = F.when(t.rlike(r"(?s)^---.*?---"), F.regexp_replace(t, r"(?s)^---.*?---", "")).otherwise(t)
    return files.select(
        path, F.when(heading != "", heading).otherwise(stem).alias("title"),
        F.map_from_entries(F.transform(pairs, pair)).alias("front_matter"), rest.alias("body"),
    )


def migrate_rows(source: DataFrame, id_map: DataFrame, key: str, dims: int, vector: str) -> DataFrame:
    """Re-key rows through id_map(old_id, new_id); unmatched rows are left out, and vectors of another
    dimension are set to null."""
    mapped = source.join(id_map, F.col(key) == F.col("old_id"))
    right = F.when(F.size(vector) == dims, F.col(vector))
    return mapped.withColumn(vector, right).drop(key, "old_id").withColumnRenamed("new_id", key)
