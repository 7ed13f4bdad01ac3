"""Merge tables of byte-pair encodings, and the test whether two tokens may stand side by side.

An encoding merges the adjacent pair of lowest rank, leftmost first, until no pair has a rank. Two tokens may stand
side by side exactly if no merge across their border would have come before the merges that built them: along the
right edge of the left token and the left edge of the right one, a pair merges across if its rank is under that of the
merge that swallows its left part and not over that of the merge that swallows its right part. A sequence whose
neighbours all may stand together is the encoding of its text, and every prefix has one encoding, so encodings can be
found from left to right by looking at last tokens only.
"""

from __future__ import annotations

import base64
import json
from functools import cache

NEVER = 1 << 60


class Merges:
    """Tokens by number; `pair(a, b)` is the rank at which a and b merge, NEVER if they don't."""

    def __init__(self) -> None:
        self.spines: tuple[dict, dict] = ({}, {})
        self.together: dict[tuple[int, int], bool] = {}

    def pair(self, a: int, b: int) -> int:
        raise NotImplementedError

    def parts(self, t: int) -> tuple[int, int, int] | None:
        """Left part, right part and rank of the merge that makes t; None for a basic symbol."""
        raise NotImplementedError

    def spine(self, t: int, side: int) -> list[tuple[int, int]]:
        """Tokens along the left (0) or right (1) edge of t, each with the rank of the merge that swallows it."""
        known = self.spines[side].get(t)
        if known is None:
            known, ends, at = [], NEVER, t
            while True:
                known.append((at, ends))
                made = self.parts(at)
                if made is None:
                    break
                at, ends = made[side], made[2]
            self.spines[side][t] = known
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a."""
        key = (a, b)
        known = self.together.get(key)
        if known is None:
            if len(self.together) > 200_000:
                self.together.clear()
            pair = self.pair
            known = True
            for x, left_ends in self.spine(a, 1):
                for y, right_ends in self.spine(b, 0):
                    rank = pair(x, y)
                    if rank < left_ends and rank <= right_ends:
                        known = False
                        break
                if not known:
                    break
            self.together[key] = known
        return known


class RankedBytes(Merges):
    """A rank file: a token's number is its rank, and a pair merges at the rank of its joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.bytes = {t: b for b, t in ranks.items()}
        self.made: dict[int, tuple[int, int, int] | None] = {}
        self.longest = max(map(len, ranks), default=1)
        self.heads = {b[:n] for b in ranks for n in range(1, len(b))}

    def pair(self, a: int, b: int) -> int:
        return self.ranks.get(self.bytes[a] + self.bytes[b], NEVER)

    def parts(self, t: int) -> tuple[int, int, int] | None:
        if t not in self.made:
            body = self.bytes[t]
            row = [self.ranks[body[i : i + 1]] for i in range(len(body))]
            while len(row) > 2:
                at = min(range(len(row) - 1), key=lambda i: self.pair(row[i], row[i + 1]))
                joined = self.pair(row[at], row[at + 1])
                if joined >= t:
                    break
                row[at : at + 2] = [joined]
            self.made[t] = (row[0], row[1], t) if len(row) == 2 else None
        return self.made[t]


class WordMerges(Merges):
    """A merge list over byte symbols whose last symbol of a word is marked."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], mark: str):
        super().__init__()
        names = byte_names()
        back = {c: b for b, c in names.items()}
        self.ranked = {(vocabulary[a], vocabulary[b]): i for i, (a, b) in enumerate(merges)}
        self.made = {vocabulary[a + b]: (vocabulary[a], vocabulary[b], i) for i, (a, b) in reversed(list(enumerate(merges)))}
        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        singles = set(names.values()) | {c + mark for c in names.values()}
        for text, t in vocabulary.items():
            if t in self.made or text in singles:
                ends = text.endswith(mark)
                body = text[: -len(mark)] if ends else text
                if all(c in back for c in body):
                    (self.closed if ends else self.open)[bytes(back[c] for c in body)] = t
        self.longest = max([*map(len, self.open), *map(len, self.closed)])

    def pair(self, a: int, b: int) -> int:
        return self.ranked.get((a, b), NEVER)

    def parts(self, t: int) -> tuple[int, int, int] | None:
        return self.made.get(t)


@cache
def byte_names() -> dict[int, str]:
    """One printable character per byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def ranked_bytes(path: str) -> RankedBytes:
    with open(path, "rb") as f:
        return RankedBytes({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@cache
def word_merges(path: str) -> WordMerges:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return WordMerges(model["vocab"], pairs, model["end_of_word_suffix"])
