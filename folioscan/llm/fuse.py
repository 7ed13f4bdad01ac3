"""Binary fuse filters (three-wise, eight-bit fingerprints) over 64-bit keys, built and probed in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

U64 = np.uint64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix of key and seed."""
    h = keys + U64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> U64(shift))) * U64(factor)
    return h ^ (h >> U64(33))


@dataclass(frozen=True)
class Fuse:
    seed: int
    segment: int
    segments: int
    table: np.ndarray

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key put in, and for about 1 in 256 of the others."""
        h = mixed(keys, self.seed)
        a, b, c = slots(h, self.segment, self.segments)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == prints(h)


def prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> U64(32))).astype(np.uint8)


def slots(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three slots in three consecutive segments."""
    first = ((h >> U64(32)) * U64(segment * segments)) >> U64(32)
    mask = U64(segment - 1)
    second = (first + U64(segment)) ^ ((h >> U64(18)) & mask)
    third = (first + U64(2 * segment)) ^ (h & mask)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def build(keys: np.ndarray) -> Fuse:
    """Peel the keys in vectorised rounds: every slot with one key left names that key; fill in reverse order."""
    keys = np.unique(keys)
    n = max(len(keys), 2)
    segment = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    room = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    segments = max(1, -(-room // segment) - 2)
    seed = 0
    while True:
        seed += 1
        order = peel(mixed(keys, seed), segment, segments)
        if order is not None:
            break
        segments += seed > 3  # a slightly larger table after repeated failures
    h = mixed(keys, seed)
    where = np.stack(slots(h, segment, segments))
    wanted = prints(h)
    table = np.zeros((segments + 2) * segment, np.uint8)
    for who, slot in reversed(order):
        a, b, c = where[:, who]
        table[slot] = wanted[who] ^ table[a] ^ table[b] ^ table[c]  # the slot itself is still zero
    return Fuse(seed, segment, segments, table)


def peel(h: np.ndarray, segment: int, segments: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    where = np.stack(slots(h, segment, segments))
    size = (segments + 2) * segment
    load = np.bincount(where.ravel(), minlength=size)
    total = np.zeros(size, np.int64)
    index = np.arange(len(h))
    for row in where:
        np.add.at(total, row, index)
    order, left = [], len(h)
    look = np.flatnonzero(load == 1)
    while len(look):
        who, at = np.unique(total[look], return_index=True)
        order.append((who, look[at]))
        left -= len(who)
        gone = where[:, who]
        for row in gone:
            np.subtract.at(load, row, 1)
            np.subtract.at(total, row, who)
        touched = np.unique(gone)
        look = touched[load[touched] == 1]
    return order if not left else None
