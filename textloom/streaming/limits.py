"""Request limits and values with a time to live, over streams or batches of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_limits(events: DataFrame, key: str, window: str = "1 minute", limit: int = 60, lateness: str = "5 minutes") -> DataFrame:
    """key, window_start, requests, limited by tumbling window; events later than ``lateness`` do not count in a stream."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    counted = rows.groupBy(key, F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(key, F.col("w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("limited"))


def fresh_values(events: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """Per event of a stream: whether its key's value was still fresh (a hit) or is stored anew.

    ``events`` has key, value (double), ts. A key's events are taken a frame at a time, in
    the order of their frames and of ts within one. State is one value and its expiry per
    key; it leaves the store by event time once it is over.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, expires = state.get if state.exists else (None, -1)
        for frame in frames:
            out = []
            for row in frame.sort_values("ts", kind="stable").itertuples():
                now = int(row.ts.timestamp() * 1000)
                hit = now < expires
                if not hit:
                    value, expires = float(row.value), now + 1000 * ttl_seconds
                out.append((group[0], row.ts, value, hit))
            yield pd.DataFrame(out, columns=[key, "ts", "value", "hit"])
        state.update((value, expires))
        # Never before the watermark, which the store would refuse.
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("ts", "5 minutes")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, value double, hit boolean", "value double, expires long", "append", "EventTimeTimeout")
