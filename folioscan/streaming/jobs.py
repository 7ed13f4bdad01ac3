"""Structured Streaming forms of the monitoring and change-feed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.ids import content_hash
from folioscan.session import load, scratch_path


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's parquet files as a stream; time-zone-free stamps become event-time stamps."""
    schema = load(spark, sf_dir, name).schema
    # a pattern of one name: it finds the table as a folder of part files as well as as a single file
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")
    stamps = {f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"}
    return raw.withColumns(stamps) if stamps else raw


def tail(rows: DataFrame, events: DataFrame, end: str, late: str) -> DataFrame:
    """Rows of a finished table that its stream holds back: those whose `end` (an expression) lies after the last watermark."""
    last = F.date_trunc("millisecond", F.max("ts")) - F.expr(f"interval {late}")
    return rows.filter(F.expr(end) > events.agg(last.alias("t")).scalar())


def event_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table in one piece, with event-time stamps like the stream's."""
    table = load(spark, sf_dir, name)
    stamps = {f.name: F.col(f.name).cast("timestamp") for f in table.schema if f.dataType.typeName() == "timestamp_ntz"}
    return table.withColumns(stamps) if stamps else table


def drain(rows: DataFrame, label: str, rest: DataFrame | None = None) -> DataFrame:
    """Run an append-mode stream over everything available and return what it wrote, with `rest` after its end.

    Output and progress live in the shared folder, so a restarted query continues from its checkpoint.
    """
    spark = rows.sparkSession
    out = scratch_path(spark, label)
    job = (
        rows.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    written = spark.read.schema(rows.schema).parquet(out)
    return written if rest is None else written.unionByName(rest)


def drain_complete(rows: DataFrame, label: str) -> DataFrame:
    """Run a complete-mode aggregation; every micro-batch replaces the result table of its number."""
    spark = rows.sparkSession
    out = scratch_path(spark, label)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:06d}")

    job = (
        rows.writeStream.foreachBatch(replace).outputMode("complete")
        .option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    written = spark.read.parquet(out)
    return written.filter(F.col("batch") == written.agg(F.max("batch")).scalar()).drop("batch")


def windows(events: DataFrame, keys: list[str], width: str, slide: str | None, late: str) -> DataFrame:
    """Count, sum and mean per event-time window; rows later than `late` behind the newest are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total", "mean"
    )


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions per user. The end is an aggregate, not the window's: a filter on the window's end would reach the events
    before they are merged into sessions and take off a session's early ones. An event exactly `gap` after the last one begins
    a session; windows that touch would be merged, so they are a microsecond shorter."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap} -1 microseconds"), "user_id")
    return grouped.agg(
        F.count_if(F.col("event_type") == "view").alias("query_count"), F.count_if(F.col("event_type") == "click").alias("click_count"),
        (F.max("ts") + F.expr(f"interval {gap}")).alias("end_time"),
    ).select("user_id", F.col("session_window.start").alias("start_time"), "end_time", "query_count", "click_count")


def unique_events(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First delivery of every key within the watermark; state is bounded by `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def changed(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Stream of documents joined with the stored hashes: only new or changed ones pass."""
    old = stored.select("doc_id", F.col("content_hash").alias("_old"))
    new = documents.withColumn("content_hash", content_hash(F.col("text")))
    return new.join(old, "doc_id", "left").filter(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")
