"""Keyed state in streams: the request before each request, whatever the borders of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last long, held binary, ids binary"
# fixed value: rows of one batch of answers
ANSWERS = 100_000


def previous_requests(requests: DataFrame, key: str, late: str, forget_days: int = 30) -> DataFrame:
    """(key, event_id, ts, before) for a stream of (key, event_id, ts): ts of the key's request before, null for the first.

    A request is answered when the watermark has passed it, so that rows arriving out of order within `late` still find
    their place; ties go by event_id, rows behind the watermark are dropped. A key's state is its last request and those that wait for
    the watermark; a timer wakes it for these, and one `forget_days` after the last request drops the key: a request so
    long after the one before counts as the first. Requests are held as packed numbers, 16 bytes each, and answered in batches.
    """
    kind = requests.schema[key].dataType.simpleString()
    forget = forget_days * 86_400_000_000

    def answer(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *kept = state.get if state.exists else (None, b"", b"")
        held, ids = ([np.frombuffer(bytes(x), np.int64)] for x in kept)
        passed = state.getCurrentWatermarkMs() * 1000
        for part in [] if state.hasTimedOut else parts:
            stamps = part["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            held.append(stamps[stamps >= passed])
            ids.append(part["event_id"].to_numpy().astype(np.int64)[stamps >= passed])
        held, ids = np.concatenate(held), np.concatenate(ids)
        order = np.lexsort((ids, held))
        held, ids = held[order], ids[order]
        n = int(np.searchsorted(held, passed))
        first, last = last, int(held[n - 1]) if n else last
        if n == len(held) and (last is None or last + forget <= passed):
            state.remove()
        else:
            wake = int(held[n]) if n < len(held) else last + forget
            state.update((last, held[n:].tobytes(), ids[n:].tobytes()))
            state.setTimeoutTimestamp(max(wake, passed) // 1000 + 1)
        for a in range(0, n, ANSWERS):
            t = held[a : min(a + ANSWERS, n)]
            before = np.concatenate([[held[a - 1] if a else t[0] if first is None else first], t[:-1]])
            known = t - before < forget
            if not a and first is None:
                known[0] = False
            yield pd.DataFrame({
                key: [group[0]] * len(t), "event_id": ids[a : a + len(t)],
                "ts": pd.to_datetime(t, unit="us"), "before": pd.Series(pd.to_datetime(before, unit="us")).where(known),
            })

    rows = requests.select(key, "event_id", "ts").withWatermark("ts", late)
    out = f"{key} {kind}, event_id long, ts timestamp, before timestamp"
    return rows.groupBy(key).applyInPandasWithState(answer, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
