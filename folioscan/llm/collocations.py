"""Phrase collocation mining by Rabin-Karp fingerprints of word runs.

Lower-cased texts are split into pieces and words. A slice of texts is one row of word hashes h; with the prefix
polynomial P[i] = h[0] + h[1] B + ... + h[i-1] B^(i-1) modulo 2^64, the run of n words at i has the fingerprint
(P[i+n] - P[i]) B^-i, mixed with its language and n. So numpy hashes every run of a slice at once and no run is ever
built as a string.

1. Fingerprints of words and pairs are counted: per task, then by one shuffle of (fingerprint, count).
2. Fingerprints that occur LEAST times or more set bits in a filter of FILTER_BITS bits, made by grouped tasks; its size
   doesn't depend on the input. Runs of n words are counted only if both of their runs of n - 1 words pass the filter,
   so rare ones aren't shuffled: a run can't be more frequent than its parts.
3. Only runs that pass the filter of their length are read back from the texts: each task sends them as (phrase, count,
   pointer to a document that holds it), and the shuffle sums them by phrase. This checks every fingerprint against the
   text: phrases that share one, and false positives of the filter, get counts of their own. A full filter costs
   shuffle, never a result.

All counts are exact. Cuts, scores and containment are joins on the frequent phrases alone. A very frequent phrase is
one row per task in every shuffle; a very frequent part only repeats in a join that adaptive execution can split.

Null texts are empty. A null lang is `und`, together with the lang `und` itself. Rows that repeat (or lack) a doc_id
count like any others. Equal scores are ordered by a, then by the phrase's bytes. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import mapped, saved

LEAST, MOST_WORDS, TOP, COVER_PERCENT = 10, 3, 2000, 50
UNKNOWN = "und"
#: Bits and probes of a filter: 8 MB whatever the input, which the driver gets in CHUNKS rows.
FILTER_BITS, PROBES, CHUNKS = 1 << 26, 2, 64
#: Bytes of text that a task gathers, and fingerprints that it holds before it counts and sends them on.
SLICE_BYTES, HELD = 4 << 20, 2_000_000
SALTS = 64

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
#: BASE times this is 1 modulo 2^64.
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Lower case; every border of pieces becomes a full stop.
FOLD = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Powers:
    """BASE^i and BASE^-i for as many i as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, b)])) for b in (BASE, INVERSE))


POWERS = Powers()


class Slice:
    """Texts of one language as one row of words; a border word stands after every piece."""

    def __init__(self, texts: list[bytes], lang: str):
        self.lang, self.flat, self.starts = lang, [], []
        for text in texts:
            self.starts.append(len(self.flat))
            self.flat += text.translate(FOLD).replace(b".", b" . ").split()
            self.flat.append(b".")
        n = len(self.flat)
        codes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.flat), U64, n)
        POWERS.reach(n + 1)
        self.prefix = np.concatenate([np.zeros(1, U64), np.cumsum(codes * POWERS.up[:n])])
        self.seed = U64(xxhash.xxh3_64_intdigest(lang))
        alike = np.flatnonzero(codes == U64(xxhash.xxh3_64_intdigest(b".")))
        borders = np.array([i for i in alike.tolist() if self.flat[i] == b"."], np.int64)
        self.room = np.repeat(borders, np.diff(borders, prepend=-1)) - np.arange(n)

    def at(self, n: int) -> np.ndarray:
        """Where a run of n words of one piece begins."""
        return np.flatnonzero(self.room >= n)

    @cached_property
    def ids(self) -> tuple[np.ndarray, int]:
        """A number for each word, equal for equal words only, and how many there are."""
        known = {w: i for i, w in enumerate(dict.fromkeys(self.flat))}
        return np.fromiter(map(known.__getitem__, self.flat), np.int64, len(self.flat)), len(known)

    def keys(self, n: int, at: np.ndarray) -> np.ndarray:
        """Numbers that are equal for equal runs only."""
        ids, kinds = self.ids
        key = np.zeros(len(at), np.int64)
        for i in range(n):
            if i and kinds ** (i + 1) >= 1 << 63:
                key = np.unique(key, return_inverse=True)[1]
            key = key * kinds + ids[at + i]
        return key

    def fingerprints(self, n: int, at: np.ndarray) -> np.ndarray:
        run = (self.prefix[at + n] - self.prefix[at]) * POWERS.down[at]
        return mixed(mixed(run + self.seed) + U64(n))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Slice, np.ndarray]]:
    """Slices of the rows (doc_id, lang, text) of a task, each with its texts' doc_ids.

    Texts are gathered over batches, so that runs which repeat in a task meet; SLICE_BYTES bound what is gathered.
    """
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            body = text.encode()
            held.setdefault(lang, []).append((doc, body))
            size += len(body)
            if size >= SLICE_BYTES:
                yield from _slices(held)
                held, size = {}, 0
    yield from _slices(held)


def _slices(held: dict[str, list]) -> Iterator[tuple[Slice, np.ndarray]]:
    for lang, rows in held.items():
        yield Slice([body for _, body in rows], lang), np.array([doc for doc, _ in rows], object)


class Filter:
    """Bloom filter of fixed size over mixed fingerprints."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, marks: np.ndarray) -> np.ndarray:
        found = np.ones(len(marks), bool)
        for k in range(PROBES):
            p = ((marks >> U64(STEP * k)) & U64(FILTER_BITS - 1)).astype(np.int64)
            found &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        return found


STEP = FILTER_BITS.bit_length() - 1


def filter_of(marks: DataFrame) -> Filter:
    """The filter over a column `mark`: bits are united by 64, so that FILTER_BITS / 64 rows meet at most."""
    probes = [F.shiftrightunsigned("mark", STEP * k).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in range(PROBES)]
    bit = F.expr("shiftleft(1L, cast(_p & 63 as int))")
    slots = marks.select(F.explode(F.array(*probes)).alias("_p")).groupBy(F.shiftright("_p", 6).alias("slot")).agg(F.bit_or(bit).alias("bits"))
    size = FILTER_BITS // 64 // CHUNKS

    def united(part: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(size, np.int64)
        slot = part["slot"].to_numpy()
        whole[slot % size] = part["bits"].to_numpy()
        return pd.DataFrame({"chunk": [slot[0] // size], "bits": [whole.tobytes()]})

    out = np.zeros((CHUNKS, size), np.int64)
    for chunk, bits in slots.groupBy(F.floor(F.col("slot") / size)).applyInPandas(united, "chunk long, bits binary").collect():
        out[chunk] = np.frombuffer(bits, np.int64)
    return Filter(out.reshape(-1).view(np.uint8))


def counted(texts: DataFrame, lengths: tuple[int, ...], shorter: Filter | None = None) -> DataFrame:
    """(lang, mark, times): fingerprints with their counts, which a task sums up before they leave it.

    With `shorter`, only runs whose two parts of one word less pass it. Rows without a mark hold a language's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        words: dict[str, int] = {}
        for piece, _ in cut(batches):
            words[piece.lang] = words.get(piece.lang, 0) + len(piece.at(1))
            for n in lengths:
                at = piece.at(n)
                if shorter:
                    at = at[shorter.has(piece.fingerprints(n - 1, at))]
                    at = at[shorter.has(piece.fingerprints(n - 1, at + 1))]
                held.append(piece.fingerprints(n, at))
            if sum(map(len, held)) > HELD:
                yield summed(held)
                held = []
        if held:
            yield summed(held)
        yield counts(list(words), [None] * len(words), list(words.values()))

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        marks, times = np.unique(np.concatenate(held), return_counts=True)
        return counts([None] * len(marks), marks.view(np.int64), times)

    def counts(lang, mark, times) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(mark, pa.int64()), pa.array(times, pa.int64())], ["lang", "mark", "times"])

    found = mapped(texts.select("doc_id", "lang", "text"), run, "lang string, mark long, times long")
    # Tasks have summed up already: dealing first spares a second pass over mostly different fingerprints.
    return found.repartition("mark").groupBy("lang", "mark").agg(F.sum("times").alias("times"))


def read_back(texts: DataFrame, filters: dict[int, Filter]) -> DataFrame:
    """(lang, words, phrase, times, first_doc): phrases whose fingerprint passes its filter, counted by their text.

    Within a slice, runs are told apart by their word numbers, not by fingerprints.
    """
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    names = ["lang", "words", "phrase", "times", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, docs in cut(batches):
            flat = piece.flat
            for n, known in filters.items():
                at = piece.at(n)
                at = at[known.has(piece.fingerprints(n, at))]
                _, first, times = np.unique(piece.keys(n, at), return_index=True, return_counts=True)
                where = at[first]
                phrases = [b" ".join(flat[i : i + n]).decode() for i in where.tolist()]
                own = docs[np.searchsorted(piece.starts, where, side="right") - 1]
                columns = ([piece.lang] * len(where), [n] * len(where), phrases, times, own)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    found = mapped(texts.select("doc_id", "lang", "text"), run, "lang string, words int, phrase string, times long, doc_id long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("times").alias("times"), F.min("doc_id").alias("first_doc"))


def frequent(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `most_words` words that occur `least` times, and (lang, n), the number of all words."""
    lang = F.coalesce("lang", F.lit(UNKNOWN))
    texts = docs.select("doc_id", lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    short = saved(counted(texts, (1, 2)).filter(F.col("mark").isNull() | (F.col("times") >= least)), "marks-2")
    filters = dict.fromkeys((1, 2), filter_of(short.filter("mark is not null")))
    for n in range(3, most_words + 1):
        longer = counted(texts, (n,), filters[n - 1]).filter(F.col("mark").isNotNull() & (F.col("times") >= least))
        filters[n] = filter_of(longer)
    phrases = saved(read_back(texts, filters).filter(F.col("times") >= least), "phrases")
    return phrases, short.filter("mark is null").select("lang", F.col("times").alias("n"))


def part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("_w", first, size), " ")


def exact_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in decimals: exact for counts under 10^15, and at most 1000000."""
    a, left, right = (f"cast({c} as decimal(15, 0))" for c in (a, left, right))
    return F.expr(f"cast((cast(1000000 as decimal(7, 0)) * ({a} * {a})) div ({left} * {right}) as bigint)")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, a, l, r, score, first_doc) by their lowest-scoring cut."""
    split = phrases.filter("words > 1").withColumn("_w", F.split("phrase", " ", -1))
    cuts = split.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.explode(F.array(
        F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")),
    ))
    asked = cuts.select("lang", "phrase", "words", "times", "first_doc", "k", sides.alias("_s")).select("*", "_s.side", "_s.part")
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("times").alias("_f"))
    met = asked.join(known, ["lang", "part"]).groupBy("lang", "phrase", "words", "times", "first_doc", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("_f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("_f"))).alias("r")
    )
    met = met.withColumn("score", exact_score("times", "l", "r"))
    best = met.groupBy("lang", "phrase", "words", F.col("times").alias("a"), "first_doc").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    return best.select("lang", "phrase", "words", "a", "_b.l", "_b.r", "_b.score", "first_doc")


def uncovered(candidates: DataFrame, phrases: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """Candidates that no longer phrase around them repeats in `percent` of 100 of their occurrences."""
    longer = phrases.filter("words > 2").withColumn("_w", F.split("phrase", " ", -1))
    sizes = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("_n"))
    inner = sizes.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_n") + 1)).alias("_i"))
    around = inner.select("lang", part(F.col("_i"), F.col("_n")).alias("phrase"), "times").groupBy("lang", "phrase").agg(F.max("times").alias("_around"))
    left = candidates.join(around, ["lang", "phrase"], "left")
    return left.filter(F.coalesce(100 * F.col("_around") < percent * F.col("a"), F.lit(True))).drop("_around")


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language: cut within SALTS shares of a language first, then among what these leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    inside = Window.partitionBy("lang", "_share").orderBy(*order)
    cut = rows.withColumn("_share", share).withColumn("_r", F.row_number().over(inside)).filter(F.col("_r") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return cut.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).drop("_share", "_r")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, and first_doc, the smallest doc_id that holds the phrase."""
    phrases, sizes = frequent(docs, least, most_words)
    rows = best(uncovered(scored(phrases), phrases), top)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc")
