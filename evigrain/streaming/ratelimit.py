"""The rate limit on a stream: state per key is the list of accepted times still in the window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ratelimit import consume


def rate_limited_stream(requests: DataFrame, most: int = 5, window: float = 60, lateness: str = "10 minutes") -> DataFrame:
    """Streaming ``requests`` (key string, request_id long, ts timestamp) -> key, request_id, allowed, retry_after (append mode).

    Requests of one micro-batch are taken in order of time and id; a late one meets the
    history as it is then, as the batch rule says, and one behind the watermark is dropped.
    A key's state goes when the watermark has passed its last accepted request and the window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["seconds", "request_id"])
        ok, wait = [], []
        for t in rows["seconds"]:
            allowed, history, retry = consume(history, t, most, window)
            ok.append(allowed)
            wait.append(retry)
        state.update((history,))
        last = max(history, default=float(rows["seconds"].max()))
        state.setTimeoutTimestamp(max(int((last + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "request_id": rows["request_id"].values, "allowed": ok, "retry_after": wait})

    timed = requests.withWatermark("ts", lateness).withColumn("seconds", F.unix_micros("ts") / F.lit(1e6))
    return timed.groupBy("key").applyInPandasWithState(step, "key string, request_id long, allowed boolean, retry_after long", "history array<double>", "append", GroupStateTimeout.EventTimeTimeout)
