"""Byte-level BPE by a lazily determinised transducer, and decoding by an incremental UTF-8 machine.

The transducer reads one byte at a time. Its state is what can still hinder a token at the last border
(the mergeable right edge of the token emitted there) and the bytes since: these fix the last token of every prefix
still open. A border is certain once every position at which a later token could start
passes through it; the tokens before it are then emitted, so the lookahead is bounded by the longest token. States and
moves are made when first needed and kept, up to STATES of them; then all are dropped and made anew. At the end of a
piece the state's remaining tokens follow. Pieces seen before are looked up whole (up to PIECES of them).

Null and empty texts have no tokens. Rows that repeat a doc_id are encoded alike. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioscan.llm.bpe import RankedBytes, ranked_bytes
from folioscan.llm.common import mapped

STATES, PIECES = 200_000, 150_000
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

Edge = tuple[tuple[int, int], ...]

#: An entry of a state's tail: a token and where it begins (before the pending bytes if negative).
ENTRY = struct.Struct("<Ii")
#: A move is one number: the next state, and above its bits the number of the tokens that became certain (0: none).
LOW, SHIFT = (1 << 32) - 1, 32


class Transducer:
    """States are kept as packed bytes and numbers, without a tuple or a dictionary of their own: a worker holds many."""

    def __init__(self, merges: RankedBytes):
        self.m = merges
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.keys: list[bytes] = []  # the edge's number in four bytes, then the pending bytes
        self.tails: list[bytes] = []
        self.lives: list[tuple[int, ...]] = []
        self.moves: dict[int, int] = {}  # by state << 8 | byte
        self.edges: dict[Edge, int] = {}
        self.edge_at: list[Edge] = []
        self.outs: dict[tuple[int, ...], int] = {(): 0}
        self.out_at: list[tuple[int, ...]] = [()]
        self.same: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.start = self.state((), b"", b"", (0,))

    def state(self, edge: Edge, pending: bytes, tail: bytes, live: tuple[int, ...]) -> int:
        """`edge`: what of the last emitted token can still hinder a token; `live`: where a later token may begin.

        `tail` has, for each prefix of the pending bytes but the empty one, its last token and where that begins.
        """
        n = self.edges.get(edge)
        if n is None:
            n = self.edges[edge] = len(self.edge_at)
            self.edge_at.append(edge)
        key = n.to_bytes(4, "little") + pending
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.tails.append(tail)
            self.lives.append(self.same.setdefault(live, live))
        return at

    def edge(self, spine: Edge | list[tuple[int, int]], pending: bytes) -> Edge:
        """The tokens of a right edge that some token beginning with the pending bytes could still merge with."""
        ranks, heads, body = self.m.ranks, self.m.heads, self.m.bytes
        found = []
        for step in spine:
            left = body[step[0]]
            if left + pending in heads or any(left + pending[:n] in ranks for n in range(1, len(pending) + 1)):
                found.append(step)
        return tuple(found)

    def hindered(self, edge: Edge, token: int) -> bool:
        pair = self.m.pair
        for y, right_ends in self.m.spine(token, 0):
            for x, left_ends in edge:
                rank = pair(x, y)
                if rank < left_ends and rank <= right_ends:
                    return True
        return False

    def move(self, at: int, byte: int) -> int:
        """The next state and the tokens that have become certain, as one number."""
        key, packed, starts = self.keys[at], self.tails[at], self.lives[at]
        edge = self.edge_at[int.from_bytes(key[:4], "little")]
        pending = key[4:] + bytes([byte])
        tail = list(ENTRY.iter_unpack(packed))
        n = len(pending)
        ranks, heads = self.m.ranks, self.m.heads
        found, live = None, []
        for begin in starts:
            body = pending[begin:]
            if body in heads:
                live.append(begin)
            if found is None:
                token = ranks.get(body)
                if token is not None and (self.m.fits(tail[begin - 1][0], token) if begin else not edge or not self.hindered(edge, token)):
                    found = (token, begin)
        tail.append(found)
        live.append(n)
        # The border is the last position that the ways to all live positions pass.
        ways = live[:]
        while len(ways) > 1 and ways[0]:
            before = tail[ways.pop() - 1][1]
            if before not in ways:
                ways.append(before)
                ways.sort()
        border = ways[0]
        out = self.path(tail, border)
        spine = edge
        if border:
            packed = b"".join([ENTRY.pack(t, b - border) for t, b in tail[border:]])
            live = [i - border for i in live if i >= border]
            pending = pending[border:]
            spine = self.m.spine(out[-1], 1)
        else:
            packed += ENTRY.pack(*found)
        edge = self.edge(spine, pending) if live[0] == 0 else ()
        made = self.outs.get(out)
        if made is None:
            made = self.outs[out] = len(self.out_at)
            self.out_at.append(out)
        step = self.moves[at << 8 | byte] = made << SHIFT | self.state(edge, pending, packed, tuple(live))
        return step

    @staticmethod
    def path(tail: list[tuple[int, int]], end: int) -> tuple[int, ...]:
        out = []
        while end:
            token, end = tail[end - 1]
            out.append(token)
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        if len(self.keys) > STATES:
            self.reset()
        at, out, moves, outs = self.start, [], self.moves, self.out_at
        for byte in piece:
            step = moves.get(at << 8 | byte)
            if step is None:
                step = self.move(at, byte)
            at = step & LOW
            if step > LOW:
                out += outs[step >> SHIFT]
        rest = list(ENTRY.iter_unpack(self.tails[at]))
        return [*out, *self.path(rest, len(rest))]


class Pieces(dict):
    """Piece to its token numbers as little-endian 32-bit integers."""

    def __init__(self, merges: RankedBytes):
        super().__init__()
        self.machine = Transducer(merges)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        body = piece.encode()
        whole = self.machine.m.ranks.get(body)  # a piece that is one token is that token
        found = self[piece] = np.array([whole] if whole is not None else self.machine.encode(body), "<u4").tobytes()
        return found


#: White space as the pattern's makers count it.
SPACE = r"\p{White_Space}"


@cache
def cutters(pattern: str):
    """The piece pattern for any text, and a faster one of the same meaning for ASCII texts."""
    every = regex.compile(pattern.replace(r"\s", SPACE).replace(r"\S", r"\P{White_Space}"))
    narrow = pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(r"[^\s", r"[^\t-\r ").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]")
    narrow = re.sub(r"\?(a-zA-Z|0-9)\+", r"?[\1]+", narrow)
    return every.findall, re.compile(narrow).findall


class Codec:
    def __init__(self, path: str, pattern: str):
        self.merges = ranked_bytes(path)
        self.pieces = Pieces(self.merges)
        self.every, self.ascii = cutters(pattern)
        self.decoder = Decoder(self.merges.bytes)

    def encode(self, text: str) -> np.ndarray:
        cut = self.ascii if text.isascii() else self.every
        return np.frombuffer(b"".join([self.pieces[p] for p in cut(text)]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.decoder.decode(ids)


@cache
def codec(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def lead(byte: int) -> tuple[int, int, int] | None:
    """After a first byte: how many bytes follow, and the bounds of the next one. None: it begins no character."""
    if byte < 0x80:
        return (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


class Decoder:
    """Token by token: a state is what is known of a begun character; moves are kept per state and token."""

    BEGIN = (0, 0, 0, 0)  # bytes to come, bounds of the next one, bits so far

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.moves: dict[tuple[tuple[int, int, int, int], int], tuple[str, tuple[int, int, int, int]]] = {}

    def feed(self, state: tuple[int, int, int, int], body: bytes) -> tuple[str, tuple[int, int, int, int]]:
        """Characters completed by these bytes, and the state after them; what cannot be a character becomes U+FFFD."""
        out = []
        todo, low, high, bits = state
        for byte in body:
            if todo:
                if low <= byte <= high:
                    todo, low, high, bits = todo - 1, 0x80, 0xBF, bits << 6 | byte & 0x3F
                    if not todo:
                        out.append(chr(bits))
                    continue
                out.append("�")
                todo = 0
            begun = lead(byte)
            if begun is None:
                out.append("�")
            elif begun[0] == 0:
                out.append(chr(byte))
            else:
                todo, low, high = begun
                bits = byte & (0x3F >> todo)
        return "".join(out), (todo, low, high, bits) if todo else self.BEGIN

    def decode(self, ids: np.ndarray) -> str:
        state, out, moves = self.BEGIN, [], self.moves
        for t in ids.tolist():
            step = moves.get((state, t))
            if step is None:
                if len(moves) > 4 * PIECES:
                    moves.clear()
                step = moves[state, t] = self.feed(state, self.tokens[t])
            text, state = step
            out.append(text)
        if state[0]:
            out.append("�")
        return "".join(out)


def texts_of(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def encoded(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (token numbers) and decoded (the text they give back) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for part in range(0, b.num_rows, 256):
                rows = b.slice(part, 256)
                ids = [c.encode(t) for t in texts_of(rows.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, marks, back = [], [], []
            for text in texts_of(b.column(1)):
                ids = c.encode(text)
                n.append(len(ids))
                marks.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
