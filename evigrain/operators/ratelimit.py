"""Sliding-window rate limits: only accepted requests count, so this is a fold over each key's requests in order.

Rows are dealt by key and sorted; the fold streams over them and holds at most
``most`` timestamps. A key with very many requests is one task's stream, not its memory.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consume(history: list[float], now: float, most: int = 5, window: float = 60) -> tuple[bool, list[float], int]:
    """(allowed, history after, seconds to wait). Timestamps that are negative, in the future or out of the window don't count."""
    if most < 1 or window < 1:
        raise ValueError("limits must be positive")
    recent = sorted(t for t in history if 0 <= t <= now and now - t < window)
    if len(recent) >= most:
        return False, recent, max(1, int(window - (now - recent[0]) + 0.999))
    bisect.insort(recent, now)
    return True, recent, 0


def rate_limited(requests: DataFrame, key: str, id_col: str, most: int = 5, window: float = 60) -> DataFrame:
    """``requests`` (key, id_col, seconds double) -> key, id_col, allowed, retry_after; ties by id."""
    kinds = {c: requests.schema[c].dataType.simpleString() for c in (key, id_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, history = object(), []
        for b in batches:
            ok, wait = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != last:
                    last, history = k, []
                allowed, history, retry = consume(history, t, most, window)
                ok.append(allowed)
                wait.append(retry)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_()), pa.array(wait, pa.int64())], [key, id_col, "allowed", "retry_after"])

    rows = requests.select(key, id_col, F.col("seconds").cast("double").alias("seconds")).where(F.col("seconds").isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, "seconds", id_col).mapInArrow(run, f"`{key}` {kinds[key]}, `{id_col}` {kinds[id_col]}, allowed boolean, retry_after long")
