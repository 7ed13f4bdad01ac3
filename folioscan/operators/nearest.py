"""Exact nearest-neighbour search over vector columns.

Every chunk is scored against the query vectors by one matrix product per Arrow batch, and only the
best k rows per query leave a batch, so the exchange carries k rows per query and batch, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.session import BROADCAST_LIMIT_BYTES

SCORE_DIGITS = 6
QUERY_TILE, ROW_TILE = 1024, 4096


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int | None) -> np.ndarray:
    """List column to a dense float64 matrix; unequal lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return flat.reshape(0, dims or 0)
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths[0]) if dims is None else dims
    if (lengths != width).any():
        raise ValueError("vector dimensions differ")
    return flat.reshape(n, width)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _score_block(q_ids, q_unit, c_ids, c_unit, k, floor) -> pd.DataFrame:
    """Best k of the rows per query by (score desc, id asc), multiplied tile by tile: memory depends on the tiles, not on
    the number of queries. A tile's cut is the k-th score of each query at once; ties at the cut go on."""
    out = []
    for a in range(0, len(q_ids), QUERY_TILE):
        tile, kept = q_unit[a : a + QUERY_TILE], []
        for b in range(0, len(c_ids), ROW_TILE):
            scores = np.round(tile @ c_unit[b : b + ROW_TILE].T, SCORE_DIGITS) + 0.0
            cut = scores.shape[1] - min(k, scores.shape[1])
            keep = scores >= np.partition(scores, cut, axis=1)[:, cut : cut + 1]
            row, column = np.nonzero(keep if floor is None else keep & (scores >= floor))
            kept.append((row, column + b, scores[row, column]))
        row, column, value = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.empty(0, int),) * 3
        tie = c_ids[column]
        order = np.lexsort((tie.astype(str) if tie.dtype == object else tie, -value, row))
        grouped = row[order]
        first = order[np.arange(len(order)) - np.searchsorted(grouped, grouped) < k]
        out.append(pd.DataFrame({"query_id": q_ids[a + row[first]], "chunk_id": c_ids[column[first]], "similarity": value[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "similarity": []})


def _rank(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_similar(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    min_similarity: float | None = None,
    query_limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Best k chunks per query by cosine similarity (rounded), ties by chunk id.

    queries(query_id, vector array) and chunks(chunk_id, vector array). A set of query vectors below
    query_limit_bytes is sent to the tasks that scan the chunks; a larger set is matched block against
    block, with bounded cells and the same result.
    """
    return _search(_present(queries), _present(chunks), k, min_similarity, query_limit_bytes, None)


def probe_centroids(
    queries: DataFrame, chunks: DataFrame, cells: DataFrame, k: int, probes: int, query_limit_bytes: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Approximate search: each query is scored only against the chunks of its `probes` nearest cells.

    cells(cell_id, vector) partitions the chunks; chunks(chunk_id, cell_id, vector).
    """
    nearest = top_k_similar(queries, cells.select(F.col("cell_id").alias("chunk_id"), "vector"), probes)
    visits = nearest.select("query_id", F.col("chunk_id").alias("cell_id"))
    return _search(_present(queries).join(visits, "query_id"), _present(chunks), k, None, query_limit_bytes, "cell_id")


def _present(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vector").isNotNull() & (F.size("vector") > 0))


def _search(queries, chunks, k, floor, limit_bytes, cell: str | None) -> DataFrame:
    n_queries, n_values = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    if n_values * 8 <= limit_bytes:
        return _rank(_scan(queries, chunks, k, floor, cell), k)
    per_block = max(1, int(limit_bytes // (8 * max(1, n_values // n_queries))))
    return _rank(_grid(queries, chunks, k, floor, n_queries, per_block, cell), k)


def _scan(queries: DataFrame, chunks: DataFrame, k: int, floor: float | None, cell: str | None) -> DataFrame:
    extra = [cell] if cell else []
    held = queries.select("query_id", "vector", *extra).toArrow()  # size checked by the caller
    q_ids = held["query_id"].to_numpy()
    q_cells = held[cell].to_numpy() if cell else np.zeros(len(q_ids))
    q_unit = _unit_rows(_matrix(held["vector"], None))
    shared = queries.sparkSession.sparkContext.broadcast((q_ids, q_cells, q_unit))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ids_cells, unit = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            c_ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            c_unit = _unit_rows(_matrix(batch.column("vector"), unit.shape[1]))
            c_cells = batch.column(cell).to_numpy(zero_copy_only=False) if cell else np.zeros(len(c_ids))
            for value in np.unique(c_cells):
                q, c = ids_cells == value, c_cells == value
                if q.any():
                    scored = _score_block(ids[q], unit[q], c_ids[c], c_unit[c], k, floor)
                    yield pa.RecordBatch.from_pandas(scored, preserve_index=False)

    return chunks.select("chunk_id", "vector", *extra).mapInArrow(score, _pair_schema(queries, chunks))


def _pair_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _grid(queries, chunks, k, floor, n_queries, per_block, cell: str | None) -> DataFrame:
    """Block nested loop: each (query block, chunk block[, cell]) is one bounded task group."""
    q_blocks = -(-n_queries // per_block)
    c_blocks = max(1, -(-chunks.count() // max(per_block, 4096)))
    extra = [cell] if cell else []
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    q = queries.select("query_id", "vector", *extra, block("query_id", q_blocks).alias("qb"), F.explode(upto(c_blocks)).alias("cb"))
    c = chunks.select("chunk_id", "vector", *extra, F.explode(upto(q_blocks)).alias("qb"), block("chunk_id", c_blocks).alias("cb"))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            none = np.empty(0)
            return pd.DataFrame({"query_id": none.astype(object), "chunk_id": none.astype(object), "similarity": none})
        a, b = np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy())
        return _score_block(
            left["query_id"].to_numpy(), _unit_rows(a.astype(float)),
            right["chunk_id"].to_numpy(), _unit_rows(b.astype(float)), k, floor,
        )

    keys = ["qb", "cb", *extra]
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(match, _pair_schema(queries, chunks))


def centroids(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key: partial sums per (key, dimension), then one array of known width per key."""
    cells = vectors.select(key, F.posexplode(vector).alias("dim", "x"))
    means = cells.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))  # as many entries as dimensions
    return means.groupBy(key).agg(F.transform(ordered, lambda s: s["x"]).alias("vector"))


def list_count(rows: DataFrame) -> DataFrame:
    """One row (n, lists): how many cells an inverted vector index of these rows should have, about the root of their number."""
    root = F.floor(F.sqrt(F.col("n"))).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("lists", F.greatest(F.lit(10), F.least(F.lit(1000), root)).cast("long"))
