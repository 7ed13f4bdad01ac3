"""Connected components by repeated minima and short cuts; one row per node, never a whole component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import saved

#: Links per task of a round, and per file that it writes; there are no fewer tasks than cores.
LINKS_PER_TASK = 250_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for all nodes of `edges` (a, b), given in one direction or both.

    Each round takes the least root among a node's neighbours, hooks the node's old root to it as well, and then lets
    every node take its root's root. Minima are folded map-side, so a hub's edges don't meet in one task. Ends with
    the first round that changes nothing. A round writes as many files as its links call for, however many shuffle
    partitions there are: each file of few rows costs a task and, on a local disk, processes that set its rights.
    """
    links = edges.select("a", "b").filter("a <> b")
    links = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-links.count() // LINKS_PER_TASK))
    roots = saved(links.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")).coalesce(tasks), "roots")
    while True:
        near = links.join(roots, links["b"] == roots["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("best"))
        hooks = least.select("node", "best").unionByName(least.filter("best < root").select(F.col("root").alias("node"), "best"))
        lower = hooks.groupBy("node").agg(F.min("best").alias("best"))
        upper = lower.select(F.col("node").alias("_up"), F.col("best").alias("_top"))
        short = lower.join(upper, lower["best"] == upper["_up"], "left").select("node", F.least("best", F.coalesce("_top", "best")).alias("root"))
        after = saved(short.coalesce(tasks), "roots")
        moved = after.join(roots.withColumnRenamed("root", "old"), "node").filter("root <> old")
        done = moved.isEmpty()
        roots = after
        if done:
            return roots
