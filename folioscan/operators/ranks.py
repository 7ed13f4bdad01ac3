"""Exact positions, order statistics and ordered folds that never bring one whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.session import cut_lineage

BUCKETS = 256


def global_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based position over the whole table by ascending `order` (which must end in a unique column).

    The rows are range-partitioned and kept by a reliable checkpoint, so the partition numbers used for
    counting and for numbering are the same even if tasks are rerun. Only one count per partition meets.
    """
    spread = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    spread = cut_lineage(spread)
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        spread.withColumn("_local", local).join(offsets, "_part")
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_part", "_local", "_before")
    )


def order_statistics(df: DataFrame, keys: list[str], value: str, targets: dict[str, Column]) -> DataFrame:
    """Exact values at given 0-based sorted positions per key.

    `targets` maps output names to position expressions over `n` (the row count of the key). Equal values
    are counted map-side, counts are summed in BUCKETS equal-width ranges per key, and only the ranges that
    hold a target are ordered, so a key holding a third of all rows is spread over its ranges.
    """
    if not keys:
        return order_statistics(df.withColumn("_all", F.lit(0)), ["_all"], value, targets).drop("_all")
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    span = cells.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / BUCKETS
    slot = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    placed = cells.join(span, keys).withColumn("_b", slot.cast("int"))
    totals = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"), F.max("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("long").alias("i")) for k, v in targets.items()]))
    ranges = (
        totals.withColumn("_end", F.sum("_t").over(upto)).withColumn("_start", F.col("_end") - F.col("_t"))
        .select(*keys, "_b", "_start", "_end", wanted.alias("_w"))
        .filter((F.col("_w.i") >= F.col("_start")) & (F.col("_w.i") < F.col("_end")))
    )
    inside = placed.drop("n").join(ranges, [*keys, "_b"])
    fine = Window.partitionBy(*keys, "_b", "_w.k").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = inside.withColumn("_cum", F.col("_start") + F.sum("_c").over(fine)).filter(
        (F.col("_w.i") < F.col("_cum")) & (F.col("_w.i") >= F.col("_cum") - F.col("_c"))
    )
    picks = [F.max(F.when(F.col("_w.k") == k, F.col(value))).alias(k) for k in targets]
    return hit.groupBy(*keys).agg(*picks)


def position_from_end(df: DataFrame, keys: list[str], segment: Column, order: list[Column]) -> DataFrame:
    """0-based distance of each row from the newest row of its key, as column `from_end`.

    `segment` must be monotone in the order (for instance the day); rows are numbered inside a segment and
    shifted by the sizes of the later segments.
    """
    cut = df.withColumn("_seg", segment)
    sizes = cut.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_seg", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_after"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order)) - 1
    return cut.withColumn("_i", inner).join(shift, [*keys, "_seg"]).withColumn("from_end", F.col("_i") + F.col("_after")).drop("_seg", "_i", "_after")


def moving_average(df: DataFrame, keys: list[str], value: str, segment: Column, newest_first: list[Column], alpha: float = 0.1) -> DataFrame:
    """Final exponential moving average per key (first sample as start value).

    The recursion unrolls to a weighted sum: alpha*(1-alpha)^j for the j-th newest sample and (1-alpha)^(n-1)
    for the oldest, so it is an ordinary aggregate over positions.
    """
    placed = position_from_end(df, keys, segment, newest_first)
    n = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = placed.join(n, keys)
    decay = F.pow(F.lit(1.0 - alpha), F.col("from_end"))
    weight = F.when(F.col("from_end") == F.col("_n") - 1, decay).otherwise(alpha * decay)
    return joined.groupBy(*keys).agg(F.sum(weight * F.col(value)).alias("ema"), F.max("_n").alias("samples"))


def previous_value(df: DataFrame, keys: list[str], value: str, order: list[str], segment: Column, name: str) -> DataFrame:
    """Value of the preceding row per key, numbered segment by segment.

    `segment` must be monotone in `order`; the first row of a segment takes the last value of the segment
    before it, so one key's rows are spread over its segments.
    """
    cut = df.withColumn("_seg", segment)
    last = cut.groupBy(*keys, "_seg").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_seg"))).drop("_last")
    inner = Window.partitionBy(*keys, "_seg").orderBy(*order)
    seen = cut.withColumn("_prev", F.lag(value).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    joined = seen.join(carried, [*keys, "_seg"])
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))).drop(
        "_seg", "_prev", "_first", "_carry"
    )
