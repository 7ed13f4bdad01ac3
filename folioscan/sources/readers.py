"""Distributed readers for the inputs a documentation index is built from."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions import html
from folioscan.operators.ingest import parse_markdown

DOCUMENT_SCHEMA = (
    "doc_id string, title string, source_type string, url string, author string, language string, tags array<string>, "
    "categories array<string>, content string, file_size long, custom map<string,string>, _corrupt_record string"
)
GOLD_SCHEMA = "name string, queries array<struct<id:string,query:string,relevant_docs:array<string>,domain:string>>"


def _whole_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, title, front_matter, body) of all Markdown files below a folder."""
    return parse_markdown(_whole_files(spark, root, "*.md"))


def feeds(spark: SparkSession, root: str, glob: str = "*.xml") -> DataFrame:
    """(path, title, link) of the entries of saved RSS or Atom feeds."""
    return _whole_files(spark, root, glob).select("path", F.inline(html.feed_items(F.col("text"))))


def sitemaps(spark: SparkSession, root: str, glob: str = "sitemap*.xml") -> DataFrame:
    return _whole_files(spark, root, glob).select("path", F.explode(html.sitemap_locations(F.col("text"))).alias("url"))


@F.pandas_udf(T.StringType())
def yaml_as_json(texts: pd.Series) -> pd.Series:
    """YAML text to JSON text; unreadable YAML becomes null."""
    import yaml

    def convert(text: str) -> str | None:
        try:
            return json.dumps(yaml.safe_load(text))
        except yaml.YAMLError:
            return None

    return texts.map(convert)


def source_registry(spark: SparkSession, root: str, glob: str = "*.{yaml,yml}") -> DataFrame:
    """(path, config JSON) of source configuration files; feeds validation.source_issues."""
    return _whole_files(spark, root, glob).select("path", yaml_as_json(F.col("text")).alias("config"))


def enabled_sources(registry: DataFrame) -> DataFrame:
    """Registry rows whose configuration does not switch the source off."""
    return registry.filter(F.coalesce(F.get_json_object("config", "$.enabled"), F.lit("true")) == "true")


def source_documents(spark: SparkSession, path: str) -> DataFrame:
    """Source documents in JSON lines; rows that do not parse keep their text in _corrupt_record."""
    return spark.read.schema(DOCUMENT_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, domain, doc_id) judgments of multi-line gold-set files."""
    raw = spark.read.schema(GOLD_SCHEMA).option("multiLine", "true").json(path)
    q = raw.select(F.inline("queries"))
    return q.select(F.col("id").alias("query_id"), "query", "domain", F.explode_outer("relevant_docs").alias("doc_id"))


def jdbc_table(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, options: Mapping[str, str] | None = None
) -> DataFrame:
    """A database table in `parts` key ranges read in parallel (the driver class must be on the class path)."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), fetchsize="10000"
    )
    return reader.options(**(options or {})).load()


def merged_settings(defaults: Mapping, override: Mapping) -> dict:
    """Nested settings: maps are merged key by key, every other value is replaced."""
    out = dict(defaults)
    for name, value in override.items():
        both = isinstance(value, Mapping) and isinstance(out.get(name), Mapping)
        out[name] = merged_settings(out[name], value) if both else value
    return out
