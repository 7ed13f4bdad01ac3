"""Writers: Markdown, index tables, event logs and evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def front_matter(body: Column, fields: dict[str, Column]) -> Column:
    """Body with a leading --- block of JSON-quoted values."""
    lines = [F.concat(F.lit(f"{k}: "), F.to_json(F.array(v.cast("string")))) for k, v in fields.items()]
    plain = [F.regexp_replace(line, r"^([^:]*: )\[(.*)\]$", "$1$2") for line in lines]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *plain), F.lit("\n---\n\n"), body)


def write_markdown(docs: DataFrame, path: str, folder: str, body: str, fields: list[str]) -> None:
    """One text record per document, in one sub-folder per value of `folder`."""
    text = front_matter(F.col(body), {f: F.col(f) for f in fields})
    docs.select(folder, text.alias("value")).write.mode("overwrite").partitionBy(folder).option("lineSep", "\u001e").text(path)


def write_postings(postings: DataFrame, path: str) -> None:
    """Inverted index sorted by term inside range partitions: a term look-up prunes files by statistics."""
    ordered = postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    ordered.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Table bucketed by its join key, so later joins on the key need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def append_events(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to an event log partitioned by day; retention then drops whole folders."""
    events.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def flat_results(metrics: DataFrame, performance: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with quality_ and perf_ columns."""
    q = metrics.select(*keys, *[F.col(c).alias(f"quality_{c}") for c in metrics.columns if c not in keys])
    p = performance.select(*keys, *[F.col(c).alias(f"perf_{c}") for c in performance.columns if c not in keys])
    return q.join(p, keys, "full")


def write_results(results: DataFrame, path: str, kind: str = "json") -> None:
    writer = results.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)
