"""Catalogue of registered queries: name -> (callable, SQL twin or None, survey ids)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFn
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}

MODULES = [
    "text_queries", "web_queries", "join_queries", "aggregate_queries", "window_queries", "chunk_queries",
    "retrieval_queries", "ranking_queries", "evaluation_queries", "change_queries", "lineage_queries",
    "governance_queries", "cache_queries", "monitor_queries", "stream_queries",
]


def query(name: str, ids: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under `name`; `ids` are the operator ids it covers."""

    def add(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql.strip() if sql else None, tuple(ids.split()))
        return fn

    return add


def load_all() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"folioscan.plans.{module}")
    return REGISTRY
