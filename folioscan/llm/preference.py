"""Quality classifier: Bradley-Terry ranking from preference pairs.

A pair prefers a good labelled text to a bad one; its chance is the logistic function of the difference of two scores,
and a score is linear in features of the whole text: rule statistics and the shares of hashed letter pairs. The
weights minimise the logistic loss on feature differences over PAIRS seeded pairs of at most SAMPLE_ROWS labelled
rows, none of the held-out third. The decision is a quantile of the scores of all labelled rows learnt from: as many
lie under it as are labelled bad. A published score is the logistic function of the distance to that quantile.

Null and empty texts have the features of an empty text and are scored like any other. Without both labels the score
is 0.5 for all. Rows that repeat a doc_id are scored alike; a missing doc_id counts as not held out and is never
learnt from. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import mapped, saved
from folioscan.llm.quality_rules import drawn, labelled
from folioscan.llm.textstats import COUNTS, bodies, counts, shares

SAMPLE_ROWS, PAIRS, RIDGE, STEPS = 6000, 60_000, 1e-3, 12
CELLS = 64


def held_out(column: str = "doc_id") -> Column:
    """Every third document by checksum; a missing id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3, F.lit(0)) == 1


def letter_pairs(text: bytes) -> np.ndarray:
    """Shares of hashed pairs of adjacent bytes."""
    raw = np.frombuffer(text, np.uint8).astype(np.int64)
    cells = np.bincount((raw[:-1] * 163 + raw[1:] * 97) % CELLS, minlength=CELLS) if len(raw) > 1 else np.zeros(CELLS)
    return np.sqrt(cells / max(len(raw) - 1, 1))


def features(texts: list[bytes]) -> np.ndarray:
    table = np.array([counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
    pairs = np.array([letter_pairs(t) for t in texts]).reshape(-1, CELLS)
    return np.hstack([shares(dict(zip(COUNTS, table.T))), pairs])


def fit(good: np.ndarray, bad: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets: Newton steps on the ridge-regularised pairwise logistic loss."""
    rows = np.vstack([good, bad])
    centre, spread = rows.mean(0), rows.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    rng = np.random.default_rng(seed)
    apart = (good[rng.integers(0, len(good), PAIRS)] - bad[rng.integers(0, len(bad), PAIRS)]) / spread
    w = np.zeros(rows.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(apart @ w, -30, 30)))
        slope = apart.T @ (p - 1) / PAIRS + RIDGE * w
        curve = (apart * (p * (1 - p))[:, None]).T @ apart / PAIRS + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(np.linalg.norm(step), 1e-12))
    return w / spread, centre


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, label and the features of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.array(list(features(list(bodies(b.column(1))))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), rows], ["doc_id", "label", "x"])

    return mapped(docs.select("doc_id", "text", F.col("label").cast("int").alias("label")), run, "doc_id long, label int, x array<double>")


def with_scores(docs: DataFrame, weights: np.ndarray, centre: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = (features(list(bodies(b.column(1)))) - centre) @ weights
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw)], ["doc_id", "raw"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, raw double")


def ranked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    learn = labelled(docs.select("doc_id"), labels).filter(~held_out()).distinct()
    sample = saved(drawn(learn, SAMPLE_ROWS), "preference-sample")
    # The sample has at most SAMPLE_ROWS short rows, so copying it is safe.
    rows = featured(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    good, bad = rows[rows["label"] == 1], rows[rows["label"] != 1]
    if good.empty or bad.empty:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    weights, centre = fit(np.array(good["x"].tolist()), np.array(bad["x"].tolist()))
    raw = saved(with_scores(docs, weights, centre), "preference-raw")
    seen = labelled(raw, labels).filter(~held_out())
    share = seen.agg(F.avg((F.col("label") != 1).cast("double"))).first()[0]
    # Between the quantiles on either side of the share of bad rows, so that no single row decides.
    low, high = seen.agg(F.percentile_approx("raw", [0.98 * share, share + 0.02 * (1 - share)], 100_000)).first()[0]
    score = 1 / (1 + F.exp(-(F.col("raw") - F.lit((low + high) / 2))))
    return raw.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
