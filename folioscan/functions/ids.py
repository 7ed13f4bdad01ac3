"""Hashes and derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def url_id(url: Column) -> Column:
    """Document id: first 16 hex digits of the URL's sha256."""
    return F.substring(F.sha2(url, 256), 1, 16)


def stable_chunk_id(doc_id: Column, heading_path: Column, offset: Column) -> Column:
    """Twelve hex digits over document, heading path ('root' when there is none) and offset."""
    path = F.when(F.size(heading_path) > 0, F.array_join(heading_path, "|")).otherwise(F.lit("root"))
    return F.substring(F.md5(F.concat_ws("#", doc_id, path, offset.cast("string"))), 1, 12)


def numbered_chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id, F.lit("_"), F.lpad(index.cast("string"), 4, "0"))


def section_id(url: Column, heading: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("#", url, heading, F.substring(content, 1, 100)), 256), 1, 16)


def run_lineage_id(chunker: Column, model: Column, model_version: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("-", chunker, model, model_version)), 1, 16)


def chunk_lineage_id(url: Column, index: Column, pipeline: Column, chunker: Column) -> Column:
    return F.md5(F.concat_ws(":", url, index.cast("string"), pipeline, chunker))


def five_field_lineage_id(*parts: Column) -> Column:
    """sha256 over five lineage fields, absent ones spelled 'unknown'."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts]), 256)


def search_cache_key(query: Column, filters: Column, mode: Column) -> Column:
    """Key that does not depend on the order of the filter map's entries."""
    ordered = F.array_sort(F.map_entries(filters))
    shown = F.array_join(F.transform(ordered, lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    folded = F.regexp_replace(F.lower(query), r"^\s+|\s+$", "")
    return F.concat(F.lit("search:"), F.md5(F.concat_ws("|", shown, mode, folded)))


def embedding_cache_key(text: Column, model: Column) -> Column:
    return F.concat_ws(":", F.lit("embedding"), model, F.sha2(text, 256))


def prefixed_key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *parts)


def client_key(user_id: Column, ip: Column) -> Column:
    return F.when(user_id.isNotNull(), F.concat_ws(":", F.lit("user"), user_id.cast("string"), ip)).otherwise(
        F.concat_ws(":", F.lit("ip"), ip)
    )


def random_id() -> Column:
    return F.uuid()


def register_sql_functions(spark) -> None:
    """SQL form of the lineage ids, for use in SQL text and views."""
    spark.sql(
        "create or replace temporary function generate_lineage_id(chunker string, model string, model_version string) "
        "returns string return substring(md5(concat_ws('-', chunker, model, model_version)), 1, 16)"
    )
    spark.sql(
        "create or replace temporary function generate_chunk_lineage(url string, chunk_index bigint, pipeline string, chunker string) "
        "returns string return md5(concat_ws(':', url, chunk_index, pipeline, chunker))"
    )
