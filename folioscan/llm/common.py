"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.session import load, scratch_path

#: Words are the runs outside of these six characters.
BLANKS = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def whole(text: str | Column) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends there and sizes are known to the optimizer."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows that a Python worker holds at once; whole texts may be long.
BATCH_ROWS = 1000


def slices(column: pa.Array, most_bytes: int) -> Iterator[list[bytes]]:
    """The texts of a column as UTF-8 (null: empty), in lists of at most `most_bytes`; a longer text comes alone."""
    held, size = [], 0
    for value in column.cast(pa.large_binary()):
        text = value.as_py() or b""
        if held and size + len(text) > most_bytes:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 1-based place of every row in `order` over the whole table.

    Rows are range-partitioned, sorted and written once, so places hold when tasks run again; after that only one
    count per partition meets.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    spread = saved(spread.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return spread.join(starts, "_part").withColumn(name, place.cast("long")).drop("_part", "_at", "_before")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside; for rows that hold whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """`mapInArrow` with batches small enough for whole texts, for this session from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    """Number of words; blank runs are folded first so that only one split runs over the text."""
    pieces = F.split(text, f"[{BLANKS}]+")
    edges = (F.element_at(pieces, 1) == "").cast("int") + (F.element_at(pieces, -1) == "").cast("int")
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(
        F.when(F.size(pieces) == 1, 1 - (F.element_at(pieces, 1) == "").cast("int")).otherwise(F.size(pieces) - edges)
    ).cast("long")
