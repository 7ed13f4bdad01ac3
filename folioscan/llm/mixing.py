"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the whole; shares above the cap (so many epochs of the source) are
clamped and the excess is dealt to the others by weight, round by round, until none is above. A source's target is
then met by whole repetitions of all its documents and one seeded fractional repetition: documents are dealt into
CELLS cells by a hash of seed and doc_id, and the cells are taken in order up to the cell whose end lies nearest to
what is missing. Only sums per (source, cell) meet, so a source that holds a third of all rows is never in one task.

Null texts and texts of blanks have size 0 and are taken 0 words. A null source is a source of its own, the last.
Rows that repeat a doc_id share its cell and are dealt with alike. Sources of size 0 have target 0. An empty table
gives an empty result. Other columns are kept by `mixed_documents` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import saved, whole, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
CELLS = 65536
INNER = "_mx_"


def cell(seed: str) -> Column:
    """A document's cell, 0 to CELLS - 1."""
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    return F.conv(F.substring(mark, 1, 4), 16, 10).cast("int")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", word_count(whole("text")).alias("size"), cell(seed).alias("cell"))


def filled(sources: DataFrame, total: float) -> DataFrame:
    """Adds target to (source, weight, cap): the water level rises until the open sources hold the rest.

    Each round is one aggregate over the sources; a round closes all sources whose cap lies under the level.
    """
    level = 0.0
    while True:
        over = (F.col("weight") * level >= F.col("cap")) & (F.col("cap") >= 0)
        closed, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).cast("double"),
        ).first()
        if not open_weight:
            break
        rise = (total - closed) / open_weight
        if rise <= level:
            break
        level = rise
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", F.coalesce(target, F.lit(0.0)))


def planned(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source: source, source_size, target, whole (repetitions of every document), cut (cells that get one more)."""
    cells = saved(rows.groupBy("source", "cell").agg(F.sum("size").cast("long").alias("size")), "mix-cells")
    sums = saved(cells.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-sources")
    # Sources are few next to documents: one row each is ranked here.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = saved(sums.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap")), "mix-weights")
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    aims = filled(weighed, total).select("source", "source_size", "target")
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    aims = aims.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = cells.select("source", "cell", F.sum("size").over(upto).alias("end"))
    near = ends.join(aims, ends["source"].eqNullSafe(aims["source"])).select(
        aims["source"], "cell", F.abs(F.col("end") - F.col("rest")).alias("off"), "rest"
    )
    # The empty prefix is a choice as well: it is off by the whole rest.
    best = near.groupBy("source").agg(F.min(F.struct("off", "cell")).alias("best"), F.max("rest").alias("rest"))
    cut = F.when(F.col("best.off") <= F.col("rest"), F.col("best.cell")).otherwise(F.lit(-1))
    cuts = best.select(F.col("source").alias("_s"), cut.alias("cut"))
    return aims.join(cuts, aims["source"].eqNullSafe(cuts["_s"]), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")
    )


def repetitions() -> Column:
    """How often a document is taken, from the columns of its cell and its source's plan."""
    return F.col("whole") + (F.col("cell") <= F.col("cut")).cast("int")


def mixture(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows = saved(sized(docs, seed), "mix-sizes")
    plan = saved(planned(rows), "mix-plan").withColumnRenamed("source", "_s")
    return rows.join(plan, rows["source"].eqNullSafe(plan["_s"])).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * repetitions()).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as many times as it is taken, all columns."""
    rows = saved(sized(docs, seed), "mix-sizes")
    plan = saved(planned(rows), "mix-plan")
    plan = plan.select(*[F.col(c).alias(INNER + c) for c in plan.columns])
    times = F.col(INNER + "whole") + (cell(seed) <= F.col(INNER + "cut")).cast("int")
    placed = docs.join(plan, docs["source"].eqNullSafe(plan[INNER + "source"])).withColumn(INNER + "times", times)
    return placed.withColumn(INNER + "one", F.explode(F.array_repeat(F.lit(1), F.col(INNER + "times")))).select(*docs.columns)
