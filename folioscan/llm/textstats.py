"""Counts of one whole text, as bytes; numpy and dictionaries inside a task, nothing kept between texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

OTHER, UPPER, LOWER, DIGIT, SYMBOL, POINT, BLANK, FOLLOW = range(8)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[65:91], KINDS[97:123], KINDS[48:58] = UPPER, LOWER, DIGIT
KINDS[list(b"!\"'(),-./:;?@[]_{}~^`+=\\")] = POINT
KINDS[list(b"#*$%&|<>")] = SYMBOL
KINDS[list(b" \t\n\x0b\x0c\r")] = BLANK
KINDS[0x80:0xC0] = FOLLOW

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_points")


def bodies(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column as UTF-8 bytes; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def repeated(ids: np.ndarray, kinds: int) -> int:
    """Positions inside of three-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * kinds + ids[1:-1]
    if kinds > 1_000_000:  # keeps the codes of windows within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
        kinds = max(kinds, len(ids))
    window = pair * kinds + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(ids), bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text. Words are runs outside of the six ASCII blanks; characters are code points."""
    n = np.bincount(KINDS[np.frombuffer(text, np.uint8)], minlength=8)
    words = text.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words), int(n.sum() - n[BLANK] - n[FOLLOW]), int(n[SYMBOL]), len(lines) - len(set(lines)),
        repeated(ids, len(known)), len(lines), len(known), int(n[UPPER]), int(n[LOWER]), int(n[DIGIT]), int(n[POINT]),
    )


def shares(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics of many texts, one row each, free of the text's length but for its logarithm."""
    v = {k: np.asarray(c[k], np.float64) for k in COUNTS}
    words, chars, lines = np.maximum(v["n_words"], 1), np.maximum(v["word_chars"], 1), np.maximum(v["n_lines"], 1)
    return np.column_stack([
        np.log1p(v["n_words"]), chars / words, v["n_symbols"] / words, v["n_dup_lines"] / lines, v["n_repeat_words"] / words,
        v["n_distinct"] / np.sqrt(words), v["n_upper"] / chars, v["n_digits"] / chars, v["n_points"] / words, np.log1p(words / lines),
    ])
