"""Target-distribution importance resampling by bit-sliced aggregation.

Every run of one to three words is a feature; its bucket is its crc32 modulo BUCKETS. A bucket's gain says how much
likelier it is in the target than in the corpus. A document's bucket counts are cut into bit planes: plane j has one
bit per bucket, set where bit j of the count is set. The gains are cut alike, positive and negative parts apart. The
document's weight is then a sum of 2^(j + k) times the popcount of (count plane j AND gain plane k), exact in integers.
Drawn are the documents of the highest weight plus seeded Gumbel noise, which samples without replacement in
proportion to exp(weight / 1000).

Checksums of runs are put together from the checksums of their words: crc32 is linear, so appending a word shifts the
checksum by the word's length and adds the word's own. No run is ever built as a string.

Texts are read twice, as a target's gains need the whole corpus first. Only BUCKETS sums per task meet, and BUCKETS
pairs of counts reach the driver, whatever the input's size. Ranks come from range partitions of short rows.

Null and empty texts have no features and weight 0 and aren't drawn. A null doc_id draws as the empty string and
comes last among ties. Rows that repeat a doc_id are documents of their own; wholly equal ones are ranked in any
order. Without a corpus or without a target the formula still holds (counts of 0). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import mapped, numbered, saved, slices

BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PERCENT = 5
SEED = "42"
#: Words of one slice of texts that a worker holds at once; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Tables of checksum shifts reach so many bytes; longer words take several steps. Arrays are worked on in strides that stay in cache.
FAR, STRIDE = 64, 1 << 14

#: Upper case to lower case; bytes outside of words to blanks.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def _shift_tables() -> np.ndarray:
    """For n = 0 to FAR: four tables of 256 that move a checksum past n more bytes, one per byte of the checksum."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    tables = np.empty((FAR + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(FAR):
        tables[n + 1] = one[tables[n] & 255] ^ (tables[n] >> 8)
    return tables.reshape(-1)


_SHIFT = _shift_tables()


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums after `by` more bytes, still to be combined with the checksum of those bytes."""
    out = np.empty(len(crc), np.uint32)
    for at in range(0, len(crc), STRIDE):
        part, left = crc[at : at + STRIDE], by[at : at + STRIDE].copy()
        while (far := np.flatnonzero(left > FAR)).size:
            part = part.copy()
            part[far] = _moved(part[far], np.full(len(far), FAR))
            left[far] -= FAR
        out[at : at + STRIDE] = _moved(part, left)
    return out


def _moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    at, rest = by * 1024, crc.astype(np.int64)
    out = _SHIFT.take(at + (rest & 255))
    for _ in range(3):
        at += 256
        rest >>= 8
        out ^= _SHIFT.take(at + (rest & 255))
    return out


def buckets(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word counts of the texts, and the buckets of their runs of one, two and three words, run by run.

    Array n - 1 has one entry per word, for the run of n words that begins there; -1 where the text ends before.
    """
    words = [t.translate(FOLD).split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    n = len(flat)
    one = np.fromiter(map(zlib.crc32, flat), np.uint32, n)
    long = np.fromiter(map(len, flat), np.int64, n)
    spaced = moved(one, np.ones(n, np.int64)) ^ np.uint32(zlib.crc32(b" "))
    two = moved(spaced[:-1], long[1:]) ^ one[1:]
    three = moved(spaced[:-2], long[1:-1] + 1 + long[2:]) ^ two[1:]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    out = []
    for k, crc in ((1, one), (2, two), (3, three)):
        run = np.full(n, -1, np.int64)
        run[: len(crc)] = crc % np.uint32(BUCKETS)
        if k > 1:
            run[left < k] = -1
        out.append(run)
    return sizes, out


def planes(numbers: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative numbers, one row per bit, packed into 64-bit words."""
    bits = int(numbers.max(initial=0)).bit_length()
    out = np.zeros((bits, -(-len(numbers) // 64) * 8), np.uint8)
    for j in range(bits):
        row = np.packbits((numbers & (1 << j)).astype(bool))
        out[j, : len(row)] = row
    return out.view(np.uint64)


class Gains:
    """Signed gains as bit planes, those of the positive parts first."""

    def __init__(self, gains: np.ndarray):
        up, down = planes(np.maximum(gains, 0)), planes(np.maximum(-gains, 0))
        self.planes = np.concatenate([up, down])
        powers = [1 << k for k in range(len(up))] + [-(1 << k) for k in range(len(down))]
        self.powers = np.array(powers, np.int64)

    def weight(self, counts: np.ndarray) -> int:
        """Sum of count times gain over all buckets."""
        total = 0
        for j, plane in enumerate(planes(counts)):
            ones = np.bitwise_count(plane & self.planes).sum(axis=1, dtype=np.int32)
            total += int(ones @ self.powers) << j
        return total


def totals(docs: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; BUCKETS sums per task meet, BUCKETS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0), SLICE_BYTES):
                for runs in buckets(texts)[1]:
                    sums += np.bincount(runs + 1, minlength=BUCKETS + 1)[1:]
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["bucket", "n"])

    found = mapped(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares), each step in doubles."""
    have, want = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * have / ((s + 1) * want))) for s, t in pairs], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """A document's seeded Gumbel noise in thousandths."""
    mark = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(mark[:8], 16) + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gains: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = Gains(gains)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for texts in slices(batch.column(1), SLICE_BYTES):
                sizes, runs = buckets(texts)
                ends = np.cumsum(sizes)
                for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
                    own = np.concatenate([r[end - size : end] for r in runs]) + 1
                    counts = np.bincount(own, minlength=BUCKETS + 1)[1:]
                    weight, doc = sliced.weight(counts), ids[len(rows)]
                    rows.append((doc, size, int(counts.sum()), weight, weight + noise(doc, seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank, null where it isn't drawn."""
    gains = gains_of(totals(docs), totals(target))
    scored = saved(weighted(docs, gains, seed), "importance")
    fit = F.col("n_words") >= LEAST_WORDS
    drawn = scored.filter(fit).count() * percent // 100
    placed = numbered(scored.withColumn("_fit", fit), [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("doc_id")], "_place")
    rank = F.when(F.col("_fit") & (F.col("_place") <= drawn), F.col("_place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def selected(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, seed: str = SEED) -> DataFrame:
    """The drawn documents themselves, all columns; rows that share a drawn doc_id stay together."""
    ids = resampled(docs, target, percent, seed).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_drawn"]), "left_semi")
