"""Change detection, upserts, section diffs and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.blocks import block_similarity
from folioscan.functions.ids import content_hash
from folioscan.operators.lineage import chunk_facts


def change_reason(crawl: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Why a crawled document differs from the stored one: new, content, etag, modified or unchanged.

    crawl(key, text, etag, last_modified string), stored(key, content_hash, etag, last_modified timestamp);
    an unreadable date counts as no date.
    """
    old = stored.select(
        key, F.col("content_hash").alias("old_hash"), F.col("etag").alias("old_etag"), F.col("last_modified").alias("old_modified"),
        F.lit(True).alias("known"),
    )
    stamp = F.expr("try_cast(last_modified as timestamp_ntz)")
    reason = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("old_hash") != content_hash(F.col("text")), "content")
        .when((F.col("etag") != "") & (F.col("old_etag") != "") & (F.col("etag") != F.col("old_etag")), "etag")
        .when(stamp > F.col("old_modified"), "modified")
        .otherwise("unchanged")
    )
    return crawl.join(old, key, "left").select(key, reason.alias("reason"))


def recrawl_needed(urls: DataFrame, stored: DataFrame, moment: Column, hours: int = 24) -> DataFrame:
    """Unknown pages and pages crawled more than `hours` ago; a known page without a date is left alone."""
    known = stored.select("page_id", "last_crawled", F.lit(True).alias("known"))
    old = F.col("last_crawled") < moment - F.make_interval(hours=F.lit(hours))
    due = F.col("known").isNull() | F.coalesce(old, F.lit(False))
    return urls.join(known, "page_id", "left").withColumn("due", due)


def needs_reprocessing(docs: DataFrame, chunks: DataFrame, version: str, model: str, chunker: str) -> DataFrame:
    j = docs.join(chunk_facts(chunks, model, chunker), "doc_id", "left")
    return j.select(
        "doc_id",
        (
            F.col("last_processed_at").isNull()
            | ~F.col("processing_version").eqNullSafe(version)
            | (F.coalesce("old_model_chunks", F.lit(0)) > 0)
            | (F.coalesce("old_chunker_chunks", F.lit(0)) > 0)
        ).alias("needed"),
    )


def hash_gate(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose content hash is not the stored one (new keys included)."""
    new = incoming.withColumn("content_hash", content_hash(F.col("text")))
    old = stored.select(key, F.col("content_hash").alias("_old"))
    return new.join(old, key, "left").filter(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row per key by `version`; max_by is combined map-side, so a hot key is no single sort."""
    both = stored.unionByName(incoming)
    rest = [c for c in both.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def delete_where_in(rows: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, one-row count of removed rows) for a delete by key set."""
    keys = doomed.select(key).distinct()
    removed = rows.join(keys, key, "left_semi").agg(F.count(F.lit(1)).alias("removed"))
    return rows.join(keys, key, "left_anti"), removed


def last_sections(rows: DataFrame, key: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, "section_id")]
    last = rows.groupBy(key, "section_id").agg(F.max_by(F.struct(*rest), F.col("start_pos")).alias("r"))
    return last.select(key, "section_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def section_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer comparison of body sections: added, deleted, modified, unchanged.

    Sections of one document that share an id count once, the last one in the document.
    """
    old, new = last_sections(old, key), last_sections(new, key)
    o = old.select(key, "section_id", F.col("content").alias("old_content"), F.col("content_hash").alias("old_hash"), F.col("path").alias("old_path"))
    n = new.select(key, "section_id", "heading", F.col("content").alias("new_content"), F.col("content_hash").alias("new_hash"), F.col("path").alias("new_path"))
    action = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    )
    return o.join(n, [key, "section_id"], "full").select(
        key, "section_id", action.alias("action"), F.coalesce("new_path", "old_path").alias("path"), "heading", "old_content", "new_content"
    )


def reprocess_plan(diff: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Adds similarity and the decision. Only texts of modified sections are compared, by their matching blocks."""
    a = F.col("action")
    texts = [F.when(a == "modified", F.col(c)).alias(f"_{c}") for c in ("old_content", "new_content")]
    compared = diff.select("*", *texts).withColumn("_alike", block_similarity("_old_content", "_new_content"))
    known = F.when(a == "unchanged", 1.0).when(a == "modified", F.col("_alike")).otherwise(0.0)
    plan = compared.withColumn("similarity", known).drop("_old_content", "_new_content", "_alike")
    again = a.isin("added", "deleted") | ((a == "modified") & (F.col("similarity") < threshold))
    return plan.withColumn("reprocess", again)


def diff_stats(plan: DataFrame, keys: list[str]) -> DataFrame:
    a = F.col("action")
    new = F.count_if(a != "deleted")
    return plan.groupBy(*keys).agg(
        *[F.count_if(a == x).alias(x) for x in ("added", "modified", "deleted", "unchanged")],
        F.round(F.count_if("reprocess") / F.greatest(new, F.lit(1)) * 100, 6).alias("reprocess_pct"),
    )


def retain(rows: DataFrame, ts: str, moment: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of deleted rows) for a retention period."""
    edge = moment - F.make_interval(days=F.lit(days))
    return rows.filter(F.col(ts) >= edge), rows.filter(F.col(ts) < edge).agg(F.count(F.lit(1)).alias("deleted"))


def event_stream_rows(results: DataFrame) -> DataFrame:
    """Delivery rows per query: one metadata row, one row per result by rank, one completion row."""
    header = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    row = lambda df, seq, event, payload: df.select("query_id", seq.cast("long").alias("seq"), F.lit(event).alias("event"), payload.alias("payload"))
    meta = row(header, F.lit(0), "metadata", F.to_json(F.struct("n")))
    body = row(results, F.col("rank"), "result", F.to_json(F.struct(F.col("rank").alias("index"), F.col("chunk_id").alias("id"), "similarity")))
    done = row(header, F.col("n") + 1, "complete", F.to_json(F.struct(F.col("n").alias("total"))))
    return meta.unionByName(body).unionByName(done)
