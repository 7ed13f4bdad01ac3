"""Similarity of two texts by matching blocks.

The longest block that both texts share is taken out, and the same is done on what lies left and right of it; the
similarity is twice the characters in blocks over all characters. Where the second text has 200 characters or more, a
block must hold a character that makes up at most a hundredth of it; frequent characters only lengthen blocks.

A longest block is found by bisection over its length: a length is possible if one fingerprint occurs among the windows
of both texts (prefix polynomials, so all windows of one length cost one array operation). Each level of blocks is
so linear in the texts but for logarithms, while a table of all pairs of positions would be quadratic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

FREQUENT_FROM, SMALL = 200, 4096
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Side:
    """Characters of one text with prefix polynomials; windows with frequent characters are never cores."""

    def __init__(self, codes: np.ndarray, frequent: np.ndarray):
        n = len(codes)
        self.codes = codes
        # Scrambled codes: polynomials over small numbers would collide on repetitive texts.
        scrambled = (codes.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93)
        scrambled ^= scrambled >> U64(32)
        self.prefix = np.concatenate([np.zeros(1, U64), np.cumsum(scrambled * np.cumprod(np.full(n, BASE)))])
        self.down = np.cumprod(np.full(n + 1, INVERSE))
        self.seen = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.isin(codes, frequent))])

    def windows(self, lo: int, hi: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of the core windows of one size within [lo, hi)."""
        at = np.arange(lo, hi - size + 1)
        at = at[self.seen[at + size] == self.seen[at]]
        return at, (self.prefix[at + size] - self.prefix[at]) * self.down[at]


def _core(a: _Side, b: _Side, span: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """Longest block free of frequent characters: (start in a, start in b, size), the first in a, then in b."""
    alo, ahi, blo, bhi = span
    if (ahi - alo) * (bhi - blo) <= SMALL:
        same = a.codes[alo:ahi, None] == b.codes[None, blo:bhi]
        same &= (np.diff(a.seen[alo : ahi + 1]) == 0)[:, None]
        best, run = (0, 0, 0), np.zeros(bhi - blo + 1, np.int64)
        for i in range(ahi - alo):
            run[1:] = np.where(same[i], run[:-1] + 1, 0)
            j = int(run.argmax())
            if run[j] > best[0]:
                best = (int(run[j]), i, j)
        size, i, j = best
        return (alo + i - size + 1, blo + j - size, size) if size else (alo, blo, 0)
    # Longest blocks of unlike texts are short, so lengths grow from below until one fails, then bisection goes on.
    least, most, size, grows, found = 0, min(ahi - alo, bhi - blo), 16, True, None
    while least < most:
        size = min(size, most)
        at, marks = a.windows(alo, ahi, size)
        to, others = b.windows(blo, bhi, size)
        hit = np.flatnonzero(np.isin(marks, others))
        if len(hit):
            least, found = size, (int(at[hit[0]]), int(to[np.flatnonzero(others == marks[hit[0]])[0]]), size)
        else:
            most, grows = size - 1, False
        size = size * 4 if grows else (least + most + 1) // 2
    return found or (alo, blo, 0)


def matched(old: str, new: str) -> int:
    """Characters of `old` that lie in blocks shared with `new`."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (old, new)]
    frequent = np.empty(0, np.uint32)
    if len(new) >= FREQUENT_FROM:
        kinds, times = np.unique(codes[1], return_counts=True)
        frequent = kinds[times > len(new) // 100 + 1]
    a, b = (_Side(c, frequent) for c in codes)
    total, todo = 0, [(0, len(old), 0, len(new))]
    while todo:
        span = alo, ahi, blo, bhi = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        i, j, size = _core(a, b, span)
        before = _common(a.codes[alo:i][::-1], b.codes[blo:j][::-1]) if size else 0
        i, j, size = i - before, j - before, size + before
        size += _common(a.codes[i + size : ahi], b.codes[j + size : bhi])
        if size:
            total += size
            todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return total


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


def ratio(old: str | None, new: str | None) -> float:
    """Similarity from 0 to 1; null counts as empty, and two empty texts are alike."""
    old, new = old or "", new or ""
    if old == new:
        return 1.0
    return 2 * matched(old, new) / (len(old) + len(new)) if old and new else 0.0


def block_similarity(old: str, new: str) -> Column:
    """Column form; a batch holds whole texts of a few pairs only, each compared by itself."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(F.col(old), F.col(new))
