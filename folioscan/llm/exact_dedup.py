"""Exact duplicates: filters per immutable snapshot, exact buckets for what they let through, bytes compared last.

A snapshot keeps one row per distinct digest and, per shard of the digest space, a static binary fuse filter. A new
batch is first folded by digest, so its own copies meet map-side. Its distinct digests are then screened shard by
shard: what the filter denies is new for certain; what it admits is joined with the snapshot's exact bucket. At last
the texts of all groups of more than one row are compared as bytes: they are grouped by digest and text.

Null texts count as empty, and empty texts are equal to one another. Rows that repeat a doc_id are counted singly and
say the same; of rows without doc_id any may stay. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm import fuse
from folioscan.llm.common import saved, whole

#: Distinct digests that one shard's filter holds, and the least number of shards.
SHARD_KEYS, LEAST_SHARDS = 50_000, 64
#: Every blank run but a single space; replaced by one space.
RUNS = r"\x20?[\x09-\x0D][\x20\x09-\x0D]*|\x20{2}[\x20\x09-\x0D]*"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole(text), RUNS, " ")


def digest_of(text: str | Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def folded(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of a batch."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def sharded(groups: DataFrame, shards: int) -> DataFrame:
    part = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % shards
    return groups.withColumn("shard", part.cast("int"))


def keys_of(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)[:, 1].copy()


def shard_filter(rows: pd.DataFrame) -> pd.DataFrame:
    f = fuse.build(keys_of(rows["digest"]))
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "cells": [f.table.tobytes()]})


def screened(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    out = rows[["digest", "keep_id", "group_size"]]
    if rows.empty or filters.empty:
        return out.iloc[:0]
    f = filters.iloc[0]
    held = fuse.Fuse(int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["cells"], np.uint8))
    return out[held.contains(keys_of(rows["digest"]))]


class Snapshot:
    """Distinct digests of the rows seen so far with their filters; both are written once and never changed."""

    def __init__(self, rows: DataFrame):
        self.groups = saved(folded(rows), "snapshot-groups")
        self.shards = max(LEAST_SHARDS, -(-self.groups.count() // SHARD_KEYS))
        built = sharded(self.groups.select("digest"), self.shards).groupBy("shard").applyInPandas(
            shard_filter, "shard int, seed long, segment int, segments int, cells binary"
        )
        self.filters = saved(built, "snapshot-filters")

    def admitted(self, batch: DataFrame) -> DataFrame:
        """The folded digests of a batch that may be in the snapshot."""
        left = sharded(batch, self.shards).groupBy("shard")
        return left.cogroup(self.filters.groupBy("shard")).applyInPandas(screened, "digest binary, keep_id long, group_size long")

    def merged(self, rows: DataFrame) -> DataFrame:
        """Groups of the snapshot and the batch together."""
        batch = saved(folded(rows), "batch-groups")
        hits = saved(
            self.admitted(batch).join(self.groups.select("digest", F.col("keep_id").alias("_k"), F.col("group_size").alias("_n")), "digest")
            .select("digest", F.least("keep_id", "_k").alias("keep_id"), (F.col("group_size") + F.col("_n")).alias("group_size")),
            "batch-hits",
        )
        return (
            hits.unionByName(self.groups.join(hits.select("digest"), "digest", "left_anti"))
            .unionByName(batch.join(hits.select("digest"), "digest", "left_anti"))
        )


def decided(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """doc_id, digest, keep_id, group_size of every row; `in_snapshot` says which rows were there before."""
    rows = saved(docs.select("doc_id", digest_of("text").alias("digest"), F.coalesce(in_snapshot, F.lit(False)).alias("old")), "digests")
    groups = Snapshot(rows.filter("old")).merged(rows.filter("not old"))
    many = saved(groups.filter("group_size > 1"), "groups")
    # Bytes: rows of one digest are one group only if their texts are one text.
    texts = (
        docs.select("doc_id", normalised("text").alias("body"), digest_of("text").alias("digest"))
        .join(many.select("digest").hint("merge"), "digest", "left_semi")
    )
    buckets = texts.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clashes = saved(
        buckets.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "clashes"
    )
    found = rows.select("doc_id", "digest").join(many, "digest", "left")
    if not clashes.isEmpty():  # different texts of one digest: their rows are told apart by the text itself
        apart = texts.join(clashes, "digest", "left_semi")
        own = apart.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        split = apart.join(own, ["digest", "body"]).select("doc_id", "digest", "keep_id", "group_size").distinct()
        found = found.join(clashes, "digest", "left_anti").unionByName(split)
    lone = F.col("group_size").isNull()
    return found.select(
        "doc_id", "digest", F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )


def older_half(docs: DataFrame) -> Column:
    """The rows up to the middle of the id range, taken as the snapshot of earlier work."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= ((low or 0) + (high or 0)) // 2


def exact_dedup(docs: DataFrame, in_snapshot: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = decided(docs.select("doc_id", "text"), older_half(docs) if in_snapshot is None else in_snapshot)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns; of rows that repeat doc_id and text one stays."""
    stay = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_stay"), F.unhex("text_sha256").alias("_mark"))
    marked = docs.withColumn("_own", digest_of("text"))
    same = (F.col("doc_id").eqNullSafe(F.col("_stay"))) & (F.col("_own") == F.col("_mark"))
    return marked.join(stay, same, "left_semi").dropDuplicates(["doc_id", "_own"]).select(*docs.columns)
