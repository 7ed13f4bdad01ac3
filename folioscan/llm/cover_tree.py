"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are turned into whole numbers. Queries and data are indexed alike: a small set of far-apart centres, fitted on
at most SAMPLE vectors, orders all vectors by their nearest centre, and runs of that order are blocks; each block gets a
cover tree of its own. A node has a centre (one of its points) and a covering radius; children lie in half the
radius where FAN centres are enough for that, and know their true radius in any case.

For a node of queries (centre q, radius s) and one of data (centre p, radius t) no inner product is above
<q, p> + s |p| + t |q| + s t. A pair of nodes is left out when that is below the worst k-th score that any query of the
node already has. Blocks are pruned in the same way before any vector moves: each query block first meets the
data block of its highest bound, and then only those data blocks whose bound reaches its worst k-th score.

Nothing depends on luck: centres, blocks and trees decide the cost only, every pair is either scored or excluded by its
bound. Bounds get a margin above rounding. Products are exact: in doubles while the norms keep them under 2^53, in
64-bit integers else. A vector that a third of all rows share is cut into many blocks of radius 0.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without a vec_id. Vectors
meet only those of their own length. Rows that repeat a vec_id are rows of their own; only the query's own row is no
candidate of it. Equal scores go by vec_id. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import batches_of, mapped, saved

SCALE, EVERY, TOP = 256, 50, 5
#: Fitted on so many vectors at most; each length gets so many centres at most.
SAMPLE, CENTRES = 2048, 64
#: Rows of a block at 64 components; fewer where vectors are longer.
QUERY_BLOCK, DATA_BLOCK = 1024, 4096
QUERY_LEAF, DATA_LEAF, FAN = 128, 512, 16
#: Pairs of blocks that a worker holds at once.
PAIRS_HELD = 8
NONE = np.iinfo(np.int64).min
EXACT = 2.0**53


def far_apart(points: np.ndarray, most: int, within: float, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres by farthest-first choice until all lie `within` one or there are `most`; each point's centre and distance."""
    centres = [first]
    distance = np.linalg.norm(points - points[first], axis=1)
    nearest = np.zeros(len(points), np.int64)
    while len(centres) < most and distance.max() > within:
        new = int(distance.argmax())
        to_new = np.linalg.norm(points - points[new], axis=1)
        closer = to_new < distance
        nearest[closer], distance[closer] = len(centres), to_new[closer]
        centres.append(new)
    return np.array(centres), nearest, distance


class Tree:
    """Cover tree over vectors: `order` lists the rows, and a node holds the rows order[low:high]."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        points = vectors.astype(np.float64)
        order = np.arange(len(points))
        low, high, centre, radius, children = [], [], [], [], []
        todo = [(0, len(points), 0, -1)]
        while todo:
            lo, hi, at, parent = todo.pop()
            own = order[lo:hi].copy()
            apart = np.linalg.norm(points[own] - points[at], axis=1)
            node = len(low)
            low.append(lo), high.append(hi), centre.append(at), radius.append(float(apart.max())), children.append([])
            if parent >= 0:
                children[parent].append(node)
            if hi - lo > leaf and radius[node] > 0:
                middles, nearest, _ = far_apart(points[own], FAN, radius[node] / 2, int(np.flatnonzero(own == at)[0]))
                by = np.argsort(nearest, kind="stable")
                order[lo:hi] = own[by]
                ends = lo + np.cumsum(np.bincount(nearest, minlength=len(middles)))
                for k, end in enumerate(ends.tolist()):
                    todo.append((ends[k - 1] if k else lo, end, own[middles[k]], node))
        self.order, self.low, self.high, self.children = order, np.array(low), np.array(high), children
        self.vectors = vectors[order]
        self.centres, self.radius = points[centre], np.array(radius)
        self.norm = np.linalg.norm(self.centres, axis=1)
        self.longest = float(np.linalg.norm(points, axis=1).max())


class Best:
    """Per query the k highest scores so far, ties to smaller ids; `least` are scores known to be reached already."""

    def __init__(self, least: np.ndarray, k: int):
        self.scores = np.repeat(np.where(least == NONE, NONE, least - 1)[:, None], k, axis=1)
        self.rows = np.full((len(least), k), -1, np.int64)

    def add(self, at: slice, scores: np.ndarray, rows: np.ndarray, known: np.ndarray) -> None:
        """Scores of the queries `at` with the data `rows`; `known` are the ids of all data rows."""
        good = (scores >= self.scores[at, -1:]) & (scores > NONE)
        hit, column = np.flatnonzero(good.any(axis=1)), np.flatnonzero(good.any(axis=0))
        if not len(hit):
            return
        scores, rows = scores[np.ix_(hit, column)], rows[column]
        mine = np.arange(len(self.scores))[at][hit]
        k = self.scores.shape[1]
        both = np.concatenate([self.scores[mine], scores], axis=1)
        where = np.concatenate([self.rows[mine], np.broadcast_to(rows, (len(hit), len(rows)))], axis=1)
        tie = np.where(where < 0, np.iinfo(np.int64).max, known[where])
        first = np.lexsort((tie, np.where(both == NONE, np.iinfo(np.int64).max, -both)), axis=1)[:, :k]
        self.scores[mine] = np.take_along_axis(both, first, 1)
        self.rows[mine] = np.take_along_axis(where, first, 1)


def search(queries: Tree, query_rows: np.ndarray, data: Tree, data_rows: np.ndarray, data_ids: np.ndarray, best: Best) -> int:
    """Fills `best` (in the order of the queries' tree); returns the number of products computed.

    `*_rows` number the rows, so that a query's own row is known; all are in the order of the trees.
    """
    doubles = queries.longest * data.longest < EXACT
    left = queries.vectors.astype(np.float64) if doubles else queries.vectors.astype(np.int64)
    right = data.vectors.astype(np.float64) if doubles else data.vectors.astype(np.int64)

    def bounds(a: int, nodes: list[int]) -> np.ndarray:
        inner = data.centres[nodes] @ queries.centres[a]
        s, t = queries.radius[a], data.radius[nodes]
        found = inner + s * data.norm[nodes] + t * queries.norm[a] + s * t
        return found + 1 + np.abs(found) * 1e-9 + queries.longest * data.longest * 1e-12

    products, todo = 0, [(0, 0, np.inf)]
    while todo:
        a, b, bound = todo.pop()
        at = slice(queries.low[a], queries.high[a])
        if bound < best.scores[at, -1].min():
            continue
        mine, theirs = queries.children[a], data.children[b]
        if not mine and not theirs:
            over = slice(data.low[b], data.high[b])
            products += (at.stop - at.start) * (over.stop - over.start)
            scores = left[at] @ right[over].T
            scores = np.rint(scores).astype(np.int64) if doubles else scores
            scores[query_rows[at][:, None] == data_rows[over][None, :]] = NONE
            best.add(at, scores, np.arange(over.start, over.stop), data_ids)
        elif not theirs or (mine and queries.radius[a] > data.radius[b]):
            todo += [(c, b, bounds(c, [b])[0]) for c in mine]
        else:
            above = bounds(a, theirs)
            todo += [(a, theirs[i], above[i]) for i in np.argsort(above)]
    return products


def whole_numbers(column: str, scale: int = SCALE) -> Column:
    return F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(column: str) -> Column:
    """Neither null nor empty, and without null or non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def placed(vectors: DataFrame) -> DataFrame:
    """Adds dims and cell, the number of the nearest centre of that length."""
    drawn = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()
    of: dict[int, list] = {}
    for r in drawn:
        of.setdefault(len(r.v), []).append(r.v)
    centres = {}
    for dims, rows in of.items():
        points = np.array(rows, np.float64)
        centres[dims] = points[far_apart(points, CENTRES, 0.0)[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.schema.get_field_index("v"))
            dims = np.diff(v.offsets.to_numpy()) if len(v) else np.zeros(0, np.int64)
            cell = np.zeros(len(v), np.int32)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                if d in centres:
                    m, c = matrix(v.take(pa.array(rows))).astype(np.float64), centres[d]
                    cell[rows] = ((c**2).sum(axis=1)[None, :] - 2 * m @ c.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(cell)], [*b.schema.names, "dims", "cell"])

    return mapped(vectors, run, "row long, vec_id long, is_query boolean, v array<long>, dims int, cell int")


def blocks(rows: DataFrame, size: int, leaf: int) -> DataFrame:
    """One row per block of about `size` rows of 64 components: dims, block, tree (with rows and ids), centre, radius.

    Cells are laid end to end, and a row's place in its cell is drawn by a hash, so a crowded cell fills many blocks.
    """
    cells = rows.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("dims").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CENTRES rows
    starts = cells.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    room = F.greatest(F.lit(leaf), F.floor(F.lit(64 * size) / F.col("dims")))
    block = F.floor((F.col("_start") + share * F.col("_n")) / room)
    dealt = rows.join(starts, ["dims", "cell"]).select("dims", block.alias("block"), "row", "vec_id", "v")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        v = np.stack(part["v"].to_numpy())
        small = next((k for k in (np.int16, np.int32) if np.abs(v).max() <= np.iinfo(k).max), np.int64)
        tree = Tree(v.astype(small), leaf)
        kept = (tree, part["row"].to_numpy()[tree.order], part["vec_id"].to_numpy()[tree.order])
        return pd.DataFrame({
            "dims": part["dims"].iloc[:1], "block": part["block"].iloc[:1], "tree": [pickle.dumps(kept)],
            "centre": [tree.centres[0].tolist()], "radius": [float(tree.radius[0])],
        })

    return dealt.groupBy("dims", "block").applyInPandas(build, "dims int, block long, tree binary, centre array<double>, radius double")


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def met(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Searches each pair (dims, q, d, least): one row per pair with the results found and the queries' k-th scores.

    A row carries one block of each side, so what a task holds doesn't grow with the tables.
    """
    left = queries.select("dims", F.col("block").alias("q"), F.col("tree").alias("_q"))
    right = data.select("dims", F.col("block").alias("d"), F.col("tree").alias("_d"))
    rows = pairs.join(right, ["dims", "d"]).join(left, ["dims", "q"]).select("dims", "q", "d", "least", "_q", "_d")
    # Little data and much work: a number of its own keeps adaptive execution from putting all pairs together.
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "dims", "q", "d")
    kinds = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i].as_py() for n in b.schema.names}
                (qt, q_rows, q_ids), (dt, d_rows, d_ids) = pickle.loads(r["_q"]), pickle.loads(r["_d"])
                least = np.full(len(q_rows), NONE) if r["least"] is None else np.array(r["least"], np.int64)
                best = Best(least, k)
                products = search(qt, q_rows, dt, d_rows, d_ids, best)
                who, place = np.nonzero(best.rows >= 0)
                hit = best.rows[who, place]
                lists = [q_rows[who], q_ids[who], d_ids[hit], best.scores[who, place], best.scores[:, -1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["dims"]], pa.int32()), pa.array([r["q"]], pa.int64()), pa.array([r["d"]], pa.int64()), *[pa.array([x.tolist()], kinds) for x in lists], pa.array([products], pa.int64())],
                    ["dims", "q", "d", "row", "query_id", "vec_id", "score", "worst", "products"],
                )

    return mapped(rows, run, "dims int, q long, d long, row array<long>, query_id array<long>, vec_id array<long>, score array<long>, worst array<long>, products long")


def searched(embeddings: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """What the two rounds of block pairs found, one row per pair searched."""
    vectors = embeddings.filter(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.coalesce(is_query, F.lit(False)).alias("is_query"), whole_numbers("embedding", scale).alias("v")
    )
    rows = saved(placed(saved(vectors, "vectors")), "cells")
    data = saved(blocks(rows, DATA_BLOCK, DATA_LEAF), "data-blocks")
    queries = saved(blocks(rows.filter("is_query"), QUERY_BLOCK, QUERY_LEAF), "query-blocks")
    # One row per pair of blocks, centres and radii only.
    a = queries.select("dims", F.col("block").alias("q"), F.col("centre").alias("_c"), F.col("radius").alias("_s"))
    b = data.select("dims", F.col("block").alias("d"), F.col("centre").alias("_e"), F.col("radius").alias("_t"))
    size = lambda c: F.sqrt(inner(F.col(c), F.col(c)))
    above = inner(F.col("_c"), F.col("_e")) + F.col("_s") * size("_e") + F.col("_t") * size("_c") + F.col("_s") * F.col("_t")
    pairs = saved(a.join(b, "dims").select("dims", "q", "d", (above + 1 + F.abs(above) * 1e-9 + size("_c") * size("_e") * 1e-12).alias("above")), "block-pairs")
    first = pairs.groupBy("dims", "q").agg(F.max_by("d", F.struct("above", "d")).alias("d"))
    spark = embeddings.sparkSession
    with batches_of(spark, PAIRS_HELD):
        seed = saved(met(first.withColumn("least", F.lit(None).cast("array<long>")), queries, data, k), "seed")
    known = seed.select("dims", "q", F.col("d").alias("_done"), F.col("worst").alias("least"))
    rest = pairs.join(known, ["dims", "q"]).filter((F.col("d") != F.col("_done")) & (F.col("above") >= F.array_min("least")))
    with batches_of(spark, PAIRS_HELD):
        return seed, saved(met(rest.select("dims", "q", "d", "least"), queries, data, k), "rest")


def top_products(embeddings: DataFrame, is_query: Column | None = None, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest products of each query; all, if there are fewer."""
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    seed, rest = searched(embeddings, is_query, k, scale)
    found = seed.unionByName(rest).select(F.explode(F.arrays_zip("row", "query_id", "vec_id", "score")).alias("_x")).select("_x.*")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
