"""Quality rules: counts of each text, two fixed rules, and an isolation forest over the rule statistics.

The counts are taken once per text and kept. A rule is a band for one statistic, from the good rows' quantiles at TAIL
on either side; a text's rule statistics are how far it lies outside of all bands together and of its worst one. The
forest is grown on the driver from at most FOREST_ROWS labelled good rows, chosen by a hash of doc_id: TREES trees of
DRAWN rows each, random features and random cuts. A short mean path means a text unlike the good ones. The threshold on that score comes from all labelled rows: a histogram of BINS bins
per label, read for the best sum of caught bad and kept good rows while at most LOSS of the good ones are lost.

Null and blank texts have no words and fail the first rule. Rows that repeat a doc_id are judged alike. Without
labelled rows only the fixed rules decide. Labels without doc_id are ignored; of several labels the lowest counts.
Empty tables give empty results; other columns are ignored by the query and kept by `clean_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import mapped, saved
from folioscan.llm.textstats import COUNTS, bodies, counts, shares

FOREST_ROWS, TREES, DRAWN, DEPTH = 8192, 100, 256, 8
TAIL = 0.02
BINS, LOSS = 1000, 0.003
LEAST_WORDS, MOST_REPEATED = 50, 50


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([counts(t) for t in bodies(b.column(1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in found.T]], ["doc_id", *COUNTS])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def labelled(rows: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows that have a label, with it; a label given more than once counts once, the lowest."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    return rows.join(marks, "doc_id")


def drawn(rows: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows, those of the lowest hashes, the same at every run.

    Their number says where the lowest hashes end, so each task passes on about its share of them and not `limit` rows.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, 2 * limit / max(rows.count(), 1))
    return rows.filter(place <= int(share * (1 << 30))).orderBy(place, "doc_id").limit(limit)


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Bands:
    """What is usual for each statistic, and how far rows lie outside."""

    def __init__(self, good: np.ndarray):
        self.low, self.high = np.quantile(good, [TAIL, 1 - TAIL], axis=0)
        self.unit = np.maximum(good.std(0), 1e-3)

    def outside(self, rows: np.ndarray) -> np.ndarray:
        over = np.log1p(np.maximum(np.maximum(rows - self.high, self.low - rows), 0) / self.unit)
        return np.column_stack([over.sum(1), over.max(1)])


class Forest:
    """Trees as heaps: node i has the children 2i + 1 and 2i + 2; a leaf has no feature."""

    def __init__(self, good: np.ndarray, seed: int = 7):
        self.bands = Bands(good)
        rows = self.bands.outside(good)
        rng = np.random.default_rng(seed)
        nodes = 2 ** (DEPTH + 1) - 1
        self.feature = np.full((TREES, nodes), -1, np.int16)
        self.cut = np.zeros((TREES, nodes))
        self.path = np.zeros((TREES, nodes))
        size = min(DRAWN, len(rows))
        for t in range(TREES):
            self.grow(t, 0, 0, rows[rng.choice(len(rows), size, replace=False)], rng)
        self.norm = max(float(mean_path(np.array(size))), 1e-9)

    def grow(self, t: int, node: int, depth: int, rows: np.ndarray, rng: np.random.Generator) -> None:
        if len(rows) < 2:  # also where rounding puts the cut on the upper bound
            self.path[t, node] = depth
            return
        low, high = rows.min(0), rows.max(0)
        open_ = np.flatnonzero(high > low)
        if depth == DEPTH or not len(open_):
            self.path[t, node] = depth + mean_path(np.array(len(rows)))
            return
        f = int(rng.choice(open_))
        cut = rng.uniform(low[f], high[f])
        left = rows[:, f] <= cut
        self.feature[t, node], self.cut[t, node] = f, cut
        self.grow(t, 2 * node + 1, depth + 1, rows[left], rng)
        self.grow(t, 2 * node + 2, depth + 1, rows[~left], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the more easily a row is told apart from those the forest has seen."""
        rows = self.bands.outside(rows)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for t in range(TREES):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                f = self.feature[t, node]
                step = 2 * node + 1 + (rows[every, f] > self.cut[t, node])
                node = np.where(f < 0, node, step)
            total += self.path[t, node]
        return 2.0 ** (-total / TREES / self.norm)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """Adds the forest's score to rows of counts."""
    names = [f.name for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = shares({c: b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(table))], [*names, "anomaly"])

    return mapped(rows, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", anomaly double")


def threshold(rows: DataFrame, labels: DataFrame) -> float:
    """Score above which a text is rejected, from the histogram of all labelled rows that pass the fixed rules."""
    seen = labelled(rows.filter(~base_failed()), labels).groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "label").count().collect()
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in seen:
        (good if r["label"] == 1 else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        return 1.0
    kept = np.cumsum(good) / good.sum()  # good rows at or under each bin
    caught = 1 - np.cumsum(bad) / bad.sum()
    value = np.where(kept >= 1 - LOSS, kept + caught, -1.0)
    best = np.flatnonzero(value == value.max())
    return (float(best.mean()) + 1) / BINS  # in the middle of a plateau


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, COUNTS, anomaly, base_failed, kept."""
    rows = saved(counted(docs), "rule-counts")
    sample = drawn(labelled(rows, labels).filter("label = 1"), FOREST_ROWS).toPandas()
    if sample.empty:
        return rows.withColumn("anomaly", F.lit(0.0)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed"))
    marked = scored(rows, Forest(shares({c: sample[c].to_numpy() for c in COUNTS})))
    limit = threshold(marked, labels)
    return marked.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= limit))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = judged(docs, labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents kept, all columns."""
    gone = judged(docs, labels).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
