"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document's set holds its distinct five-word shingles (ASCII letters in lower case); with fewer words the whole
sequence is one shingle. Documents of the same set form a class, and only one of each class goes on.

Forest: each of TREES sorted orders reads the signature from another place on. A region is the documents that agree in
the first DEPTH places of an order; within it they are sorted by the next places, so that neighbours are those with the
longest common prefix and the depth adapts to how crowded the region is. Neighbours whose signatures agree in at least
LIKELY of all places are candidates (pairs at 0.75 agree in less with a chance under 1 in 10^8); the regions of an
order are range-partitioned, so crowded ones spread over tasks.

Candidates tie documents into clusters. Within a cluster every pair is decided on full sets, but none is emitted that
isn't needed: members are dealt into blocks of BLOCK, and each block emits only as many links as connect it. First,
every block is compared within itself and with HUBS frequent candidates of the cluster. Then the members outside
the cluster's largest component are compared with the other blocks. No two members of a cluster go undecided unless
a chain of confirmed links already joins them.

Null texts and texts without words have an empty set, are linked with nothing and stay. Rows that repeat a doc_id
share their class. An empty table gives an empty result. Other columns are kept by `without_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import mapped, saved
from folioscan.llm.components import components
from folioscan.llm.textstats import bodies

WORDS_PER_SHINGLE, PERCENT = 5, 75
TREES, DEPTH, PLACES = 32, 4, 128
LIKELY = 0.5
BLOCK, HUBS = 192, 8
WORDS_KEPT = 100_000
U64 = np.uint64
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 2**63, WORDS_PER_SHINGLE, dtype=np.int64).astype(U64) * U64(2) + U64(1)
TURNS = _rng.integers(1, 2**63, PLACES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
SHIFTS = _rng.integers(0, 2**63, PLACES, dtype=np.int64).astype(U64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class WordCodes(dict):
    """Word to a 64-bit number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


CODES = WordCodes()


def shingles(text: bytes) -> np.ndarray:
    """The set as sorted 64-bit numbers; texts shorter than a shingle give one number that no shingle has."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, U64)
    codes = CODES
    w = np.fromiter([codes[x] for x in words], U64, n)
    if n < WORDS_PER_SHINGLE:
        return mixed(np.array([np.sum(mixed(w + U64(n)) * FACTORS[:n], dtype=U64)], U64))
    m = n - WORDS_PER_SHINGLE + 1
    total = w[:m] * FACTORS[0]
    for i in range(1, WORDS_PER_SHINGLE):
        total += w[i : i + m] * FACTORS[i]
    return np.unique(mixed(total))


def signature(values: np.ndarray) -> np.ndarray:
    """PLACES minima of turned values, upper halves."""
    low = np.full(PLACES, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(values), 512):
        part = values[at : at + 512, None] * TURNS[None, :] + SHIFTS[None, :]
        np.minimum(low, part.min(0), out=low)
    return (low >> U64(32)).astype(np.uint32)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (a 64-bit number of the whole set, null if empty), places (the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, kind, places = [], [], []
            for text in bodies(b.column(1)):
                s = shingles(text)
                n.append(len(s))
                kind.append(int(mixed(np.array([np.sum(mixed(s), dtype=U64) + U64(len(s))], U64)).view(np.int64)[0]) if len(s) else None)
                places.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(kind, pa.int64()), pa.array(places, pa.binary())], ["doc_id", "n_shingles", "class", "places"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, class long, places binary")


def orders(classes: DataFrame) -> DataFrame:
    """One row per class and tree: the region (hash of the first places of that order) and the next eight places, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, PLACES)
                n = len(sig)
                tree = np.tile(np.arange(TREES, dtype=np.int32), n)
                starts = np.arange(TREES) * DEPTH
                region = np.zeros((n, TREES), U64)
                for d in range(DEPTH):
                    region = mixed(region + sig[:, (starts + d) % PLACES])
                deeper = np.zeros((n, TREES), U64)
                for d in range(DEPTH, DEPTH + 8):
                    deeper = deeper << U64(8) | (sig[:, (starts + d) % PLACES] & 255).astype(U64)
                ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tree), pa.array(region.view(np.int64).ravel()), pa.array(deeper.view(np.int64).ravel())], ["doc_id", "tree", "region", "deeper"])

    return mapped(classes.select("doc_id", "places"), run, "doc_id long, tree int, region long, deeper long")


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents next to one another in some order and in the same region; each pair once.

    The orders are range-partitioned on all their places, so a crowded region is spread over tasks. Neighbours on either
    side of a partition's border are missed in that order only, and every document stands in TREES of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            tree, region, doc = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 0))
            if last is not None:
                tree, region, doc = (np.concatenate([[x], y]) for x, y in zip(last, (tree, region, doc)))
            last = (tree[-1], region[-1], doc[-1]) if len(doc) else last
            near = (tree[1:] == tree[:-1]) & (region[1:] == region[:-1]) & (doc[1:] != doc[:-1])
            x, y = doc[:-1][near], doc[1:][near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], ["a", "b"])

    keys = ["tree", "region", "deeper", "doc_id"]
    return mapped(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), run, "a long, b long").distinct()


def candidates(classes: DataFrame) -> DataFrame:
    """The neighbours whose signatures agree in at least LIKELY of all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, PLACES) for i in (2, 3))
            likely = (x == y).mean(1) >= LIKELY
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(likely))

    pairs = saved(neighbours(orders(classes)), "neighbours")
    left = classes.select(F.col("doc_id").alias("a"), F.col("places").alias("x"))
    right = classes.select(F.col("doc_id").alias("b"), F.col("places").alias("y"))
    return mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


class Links:
    """Components of the documents of one task, so that only links that join something are emitted."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that connect the rows as far as they are alike; rows of side 0 are compared with all, the others not with one another. `root` tells what is joined already."""
    rows = rows.sort_values(["side", "doc_id"]).drop_duplicates("doc_id").reset_index(drop=True)
    sets = [shingles((t or "").encode()) for t in rows["text"]]
    sizes = np.array([len(s) for s in sets])
    found = Links(len(sets))
    known: dict[int, int] = {}
    for i, root in enumerate(rows["root"]):
        if root is not None and not pd.isna(root):
            found.join(known.setdefault(int(root), i), i)
    flat = np.concatenate(sets) if sets else np.empty(0, U64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    left = rows["side"].to_numpy() == 0
    out = []
    for i in np.flatnonzero(left):
        at = np.searchsorted(flat, sets[i])
        end = np.searchsorted(flat, sets[i], side="right")
        spans = end - at
        hits = np.repeat(at - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        common = np.bincount(owner[hits], minlength=len(sets))
        alike = (common > 0) & (100 * common >= PERCENT * (sizes + sizes[i] - common))
        alike[: i + 1] = False  # the left side stands first; these pairs have been seen
        for j in np.flatnonzero(alike):
            if found.join(int(i), int(j)):
                out.append((rows["doc_id"][i], rows["doc_id"][j]))
    return pd.DataFrame(out, columns=["a", "b"])


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) that hold on full sets and connect all documents that confirmed links can connect."""
    spec = "a long, b long"
    clusters = components(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    seats = clusters.join(ends, "node").select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"), "count")
    sizes = seats.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    seats = saved(seats.join(sizes, "cluster").withColumn("blocks", blocks).withColumn("block", dealt), "seats")
    heads = seats.filter("blocks > 1").groupBy("cluster", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(HUBS))).agg(F.max(F.struct("count", "doc_id"))["doc_id"].alias("doc_id"))
    texts = saved(
        docs.select("doc_id", "text").join(seats.select("doc_id", "cluster", "blocks", "block").hint("merge"), "doc_id").dropDuplicates(["doc_id"]),
        "cluster-texts",
    )
    root = F.lit(None).cast("long").alias("root")
    own = texts.select("cluster", "block", F.lit(0).alias("side"), "doc_id", "text", root)
    hubs = texts.filter("blocks > 1").join(heads.select("doc_id"), "doc_id").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "doc_id", "text", root
    )
    first = saved(own.unionByName(hubs).groupBy("cluster", "block").applyInPandas(linked, spec), "first-links")
    # Clusters of several blocks: members outside of the largest component meet the other blocks.
    many = texts.filter("blocks > 1")
    if many.isEmpty():
        return first
    roots = components(first)
    placed = saved(many.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "placed")
    heads = placed.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max(F.struct("count", "root"))["root"].alias("head"))
    rest = placed.join(heads, "cluster").filter("root <> head").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")).cast("int"))
    parts = rest.select("cluster", "part").distinct()
    strays = rest.select(
        "cluster", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "doc_id", "text", "root"
    )
    others = placed.join(parts, "cluster").select("cluster", "part", "block", F.lit(1).alias("side"), "doc_id", "text", "root")
    second = strays.unionByName(others).groupBy("cluster", "part", "block").applyInPandas(linked, spec)
    return saved(first.unionByName(second), "links")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = saved(signed(docs), "signatures")
    # One document of each class stands for it; the fields ride along with the least doc_id.
    least = rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    least = saved(least, "classes")
    heads = saved(rows.select("doc_id", "class", "places").join(least.select("doc_id", "class"), ["doc_id", "class"]).dropDuplicates(["class"]), "heads")
    links = confirmed(docs, saved(candidates(heads), "candidates"))
    roots = components(links)
    moved = least.join(roots, least["doc_id"] == roots["node"], "left").select(
        F.col("class"), F.coalesce("root", "doc_id").alias("component_id"), "copies", "doc_id"
    ).filter("copies > 1 or component_id <> doc_id").select("class", "component_id")
    moved = saved(moved, "moved")
    return rows.select("doc_id", "n_shingles", "class").join(moved, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns."""
    gone = near_dedup(docs).filter("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
