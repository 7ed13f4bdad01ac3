"""Vector expressions and the hashing embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.text import tokens

# fixed value: hashed tokens kept in a task
KNOWN_TOKENS = 200_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v))


def cosine(a: Column, b: Column) -> Column:
    """Row-wise cosine similarity; 0 where a norm is 0; differing lengths raise."""
    scale = norm(a) * norm(b)
    value = F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vector dimensions differ")).cast("double")
    )


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def hashed_slot(token: str, dims: int) -> int:
    """Signed slot of a token: 1..dims from its md5, negative when the next hex digit is odd."""
    digest = hashlib.md5(token.encode()).hexdigest()
    index = int(digest[:7], 16) % dims + 1
    return -index if int(digest[7], 16) % 2 else index


def _embed_batch(lists: pa.ListArray, dims: int, known: dict[str, int]) -> pa.ListArray:
    """Unit vectors of a batch of token lists; a token is hashed once per task while `known` holds it."""
    n = len(lists)
    words = lists.flatten().dictionary_encode()
    if len(known) > KNOWN_TOKENS:
        known.clear()
    distinct = words.dictionary.to_pylist()
    for word in distinct:
        if word not in known:
            known[word] = hashed_slot(word, dims)
    slots = np.fromiter((known[w] for w in distinct), dtype=np.int64, count=len(distinct))
    flat = slots[words.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    dense = np.bincount(row * dims + np.abs(flat) - 1, weights=np.sign(flat), minlength=n * dims)
    dense = dense.astype(float).reshape(n, dims)  # an all-blank batch counts as integers
    size = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, size, out=dense, where=size > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(dense.ravel()))


def hashing_embedder(dims: int = 64):
    """Pluggable text -> unit vector function; blank text gives the zero vector.

    Texts are split in the JVM; a batch's distinct tokens are hashed once each, and one bincount serves the whole batch.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def bag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for lists in batches:
            yield _embed_batch(lists, dims, known)

    # declared non-deterministic so that a filter on the vector does not embed every text twice
    once = bag.asNondeterministic()
    return lambda text: once(tokens(F.coalesce(text, F.lit(""))))


EMBEDDERS = {"hashing-64": lambda: hashing_embedder(64), "hashing-384": lambda: hashing_embedder(384)}


def register_embedder(name: str, make) -> None:
    """Make an embedding model known under a name; `make()` returns a function from a text column to a vector column."""
    EMBEDDERS[name] = make


def embedder(name: str = "hashing-64"):
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedding model {name!r}; known: {sorted(EMBEDDERS)}")
    return EMBEDDERS[name]()
