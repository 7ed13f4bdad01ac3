"""Processing state and lineage of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.ids import five_field_lineage_id
from folioscan.operators.ranks import previous_value


def coverage(docs: DataFrame, recent_since: Column) -> DataFrame:
    done = F.count("last_processed_at")
    total = F.count(F.lit(1))
    share = F.when(total > 0, done / total * 100).otherwise(0.0)
    return docs.agg(
        total.alias("total_documents"), done.alias("processed"), (total - done).alias("unprocessed"),
        F.round(share, 6).alias("coverage"), F.count_if(F.col("last_processed_at") >= recent_since).alias("recent"),
    )


def outdated(column: str, target: str) -> Column:
    """Another value than the target, or none at all."""
    return ~F.col(column).eqNullSafe(F.lit(target))


def chunk_facts(chunks: DataFrame, model: str, chunker: str) -> DataFrame:
    """One row per document: chunk count and outdated chunk counts (combined map-side)."""
    return chunks.groupBy(F.col("document_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_if(outdated("embedding_model", model)).alias("old_model_chunks"),
        F.count_if(outdated("chunker_version", chunker)).alias("old_chunker_chunks"),
    )


def reprocessing_candidates(
    docs: DataFrame, chunks: DataFrame, version: str, model: str, chunker: str, limit: int | None = None
) -> DataFrame:
    """Documents to process again; the first applicable reason wins (version, model, chunker).

    All three checks come from one join with per-document chunk counts. A limit keeps earlier reasons first.
    """
    j = docs.join(chunk_facts(chunks, model, chunker), "doc_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = (
        F.when(outdated("processing_version", version), F.struct(F.lit(1).alias("priority"), F.lit("outdated_processing_version").alias("reason")))
        .when(n("old_model_chunks") > 0, F.struct(F.lit(2).alias("priority"), F.lit("outdated_embedding_model").alias("reason")))
        .when(n("old_chunker_chunks") > 0, F.struct(F.lit(3).alias("priority"), F.lit("outdated_chunker_version").alias("reason")))
    )
    out = j.select(
        "doc_id", "url", "processing_version", reason.alias("r"), n("chunk_count").alias("total_chunks"),
        n("old_model_chunks").alias("old_model_chunks"), n("old_chunker_chunks").alias("old_chunker_chunks"),
    ).filter("r is not null").select("doc_id", "url", "r.priority", "r.reason", "processing_version", "total_chunks", "old_model_chunks", "old_chunker_chunks")
    return out.orderBy("priority", "doc_id").limit(limit) if limit else out


def reprocessing_stats(docs: DataFrame, chunks: DataFrame, version: str, model: str, chunker: str) -> DataFrame:
    j = docs.select("doc_id", "processing_version").join(chunk_facts(chunks, model, chunker), "doc_id", "left")
    s = j.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(outdated("processing_version", version)).alias("outdated_processing"),
        F.count_if(F.col("old_model_chunks") > 0).alias("outdated_embeddings"),
        F.count_if(F.col("old_chunker_chunks") > 0).alias("outdated_chunker"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum("old_model_chunks"), F.lit(0)).alias("chunks_outdated_embeddings"),
        F.coalesce(F.sum("old_chunker_chunks"), F.lit(0)).alias("chunks_outdated_chunker"),
    )
    worst_doc = F.greatest("outdated_processing", "outdated_embeddings", "outdated_chunker")
    worst_chunk = F.greatest("chunks_outdated_embeddings", "chunks_outdated_chunker")
    return s.withColumn("documents_up_to_date", F.col("total_documents") - worst_doc).withColumn(
        "chunks_up_to_date", F.col("total_chunks") - worst_chunk
    )


def consistency_issues(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(issue, n) of the four consistency checks, absent issues left out."""
    per_doc = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_if(~F.col("has_embedding")).alias("no_vector"),
        F.count_if(
            F.col("embedding_model").isNull() | F.col("chunker_version").isNull() | F.col("processing_timestamp").isNull()
        ).alias("no_lineage"),
        F.max("processing_timestamp").alias("newest"),
    )
    j = docs.select("doc_id", "last_processed_at").join(per_doc, "doc_id", "full")
    n = j.agg(
        F.count_if(F.col("chunk_count").isNull()).alias("documents_without_chunks"),
        F.coalesce(F.sum("no_vector"), F.lit(0)).alias("chunks_without_embeddings"),
        F.coalesce(F.sum("no_lineage"), F.lit(0)).alias("chunks_missing_lineage"),
        F.count_if(F.col("newest") > F.col("last_processed_at")).alias("inconsistent_timestamps"),
    )
    return n.unpivot([], n.columns, "issue", "n").filter("n > 0")


def health(issues: DataFrame) -> DataFrame:
    found = F.count(F.lit(1))
    return issues.agg(found.alias("issues_found"), F.greatest(F.lit(0), 100 - found * 10).alias("health_score"))


def document_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk totals and distinct models and chunkers per document."""
    per = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.countDistinct("embedding_model").alias("unique_embedding_models"),
        F.countDistinct("chunker_version").alias("unique_chunker_versions"),
        F.sum(F.length("content")).alias("content_length"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return docs.join(per, "doc_id", "left").select(
        "doc_id", "url", "processing_version", zero("total_chunks"), zero("unique_embedding_models"),
        zero("unique_chunker_versions"), zero("content_length"),
    )


def lineage_view(chunks: DataFrame) -> DataFrame:
    """Counts and processing period per chunker and model."""
    return chunks.groupBy("chunker_version", "embedding_model").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.countDistinct("document_id").alias("document_count"),
        F.min("processing_timestamp").alias("first_processed"),
        F.max("processing_timestamp").alias("last_processed"),
    )


def backfill(chunks: DataFrame, chunker: str, model: str) -> DataFrame:
    """Defaults for missing lineage columns and a lineage id over the completed row."""
    full = chunks.withColumn("chunker_version", F.coalesce("chunker_version", F.lit(chunker))).withColumn(
        "embedding_model", F.coalesce("embedding_model", F.lit(model))
    )
    return full.withColumn(
        "lineage_id",
        five_field_lineage_id(F.col("chunker_version"), F.col("embedding_model"), F.col("document_id"), F.col("chunk_index"), F.lit(None)),
    )


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def audit_trail(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """State changes per entity inside a period, with the previous state."""
    seen = previous_value(events, ["entity"], "state", ["ts", "event_id"], F.date_trunc("day", "ts"), "previous")
    return seen.filter((F.col("ts") >= start) & (F.col("ts") < end))
