"""Token counts at every prefix, by dynamic programming over last tokens.

Within a word the last token of each prefix follows from the last tokens of shorter prefixes, so one pass gives the
exact count at every prefix, with the word still open and with the word ended there. A text's counts are the running
sums over its words. Truncation and budget questions are then look-ups: nothing is encoded again.

A prefix is taken on the normalised text (composed, lower case, blanks dropped), as the library sees it. Strings of
special tokens in a text count as one token each, the library's default. Null and empty texts have no tokens. Rows
that repeat a doc_id are counted alike. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioscan.llm.bpe import WordMerges, word_merges
from folioscan.llm.common import mapped

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048
WORDS = 200_000


class Prefixes:
    """Counts at the prefixes of one word, given as bytes."""

    def __init__(self, merges: WordMerges):
        self.m = merges

    def of(self, word: bytes) -> tuple[list[int], list[int]]:
        """Counts of the open prefixes of 0, 1, ... bytes, and of the same prefixes ended there (0 for none)."""
        last, open_, closed = [-1], [0], [0]
        for n in range(1, len(word) + 1):
            token, begin = self.ending(self.m.closed, last, word, n)
            closed.append(open_[begin] + 1)
            token, begin = self.ending(self.m.open, last, word, n)
            last.append(token)
            open_.append(open_[begin] + 1)
        return open_, closed

    def total(self, word: bytes) -> int:
        """Count of the whole word; only its end is closed."""
        last, open_ = [-1], [0]
        for n in range(1, len(word)):
            token, begin = self.ending(self.m.open, last, word, n)
            last.append(token)
            open_.append(open_[begin] + 1)
        return open_[self.ending(self.m.closed, last, word, len(word))[1]] + 1

    def ending(self, tokens: dict[bytes, int], last: list[int], word: bytes, n: int) -> tuple[int, int]:
        """The one token that ends at n and may follow the prefix before it."""
        for begin in range(max(0, n - self.m.longest), n):
            token = tokens.get(word[begin:n])
            if token is not None and (not begin or self.m.fits(last[begin], token)):
                return token, begin
        raise ValueError(f"no token ends here: {word!r}")


@dataclass(frozen=True)
class TextCounts:
    """Running counts of one text: `ends[i]` tokens up to the end of its word i."""

    words: list[str]
    ends: np.ndarray
    counter: Counter

    @property
    def total(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def fitting(self, budget: int) -> int:
        """How many whole words fit a budget."""
        return int(np.searchsorted(self.ends, budget, side="right"))

    def at(self, word: int, size: int) -> int:
        """Tokens of the prefix that ends after `size` bytes of the given word."""
        before = int(self.ends[word - 1]) if word else 0
        return before + self.counter.prefixes.of(self.words[word].encode())[1][size]

    def cut(self, budget: int) -> tuple[int, int]:
        """The longest prefix within a budget, as whole words and bytes of the next one; never inside of a character."""
        word = self.fitting(budget)
        if word == len(self.words) or self.words[word] in self.counter.special:
            return word, 0
        body = self.words[word].encode()
        before = int(self.ends[word - 1]) if word else 0
        closed = self.counter.prefixes.of(body)[1]
        sizes = [n for n in range(len(body)) if before + closed[n] <= budget and (body[n] & 0xC0) != 0x80]
        return word, max(sizes, default=0)


class Counter(dict):
    """Word to its number of tokens."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"] for t in spec["added_tokens"]}
        self.prefixes = Prefixes(word_merges(path))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.every = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        narrow = pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r a-z0-9]")
        self.ascii = re.compile(narrow).findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")")

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = self.prefixes.total(word.encode())
        return found

    def split(self, text: str) -> list[str]:
        """Words of the normalised text."""
        if text.isascii():
            return self.ascii(text.lower())
        text = unicodedata.normalize("NFC", text)
        return self.every("".join([c.lower() for c in text]) if "Σ" in text else text.lower())

    def count(self, text: str) -> TextCounts:
        if "<|" not in text:
            words = self.split(text)
            sizes = [self[w] for w in words]
        else:
            words, sizes = [], []
            for part in self.marks.split(text):
                if part in self.special:
                    words.append(part)
                    sizes.append(1)
                else:
                    own = self.split(part)
                    words += own
                    sizes += [self[w] for w in own]
        return TextCounts(words, np.cumsum(np.array(sizes, np.int64)), self)


@cache
def counter(path: str = VOCABULARY) -> Counter:
    """One per Python worker."""
    return Counter(path)


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, fit_words (whole words within the limit), fit_bytes (bytes of the next)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            sizes, totals, whole, part = [], [], [], []
            for value in b.column(1):
                text = value.as_py() or ""
                found = c.count(text)
                word, rest = found.cut(limit)
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                totals.append(found.total)
                whole.append(word)
                part.append(rest)
            n = np.array(totals, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit), pa.array(whole, pa.int64()), pa.array(part, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_words", "fit_bytes"],
            )

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_words long, fit_bytes long")
