"""Values with a time to live, as the state of a stream.

State is one value for each key in the session's RocksDB state store (``state_on_disk``), and a timer of event
time that takes the key out of the store once its value is over. What a key holds is order-free: of the
values that the stream brings, in whatever order and micro-batch, the one with the latest ts (of equal ts, the
largest). Rows are looked at one by one, so a key with most of the rows needs no more memory than another.

Defined results: a null key or ts, or a value that is null or no number, is no value and is left out. A row behind the watermark is dropped by
the stream; one that is over already is not stored. A key stays by the expiry in milliseconds, as timers do.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "change string, value double, ts_us long, expires_ms long"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which timers and a time to live need; the setting is given back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Newest(StatefulProcessor):
    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "ts_us long, value double, expires_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.held.get()
        best = (before[0], before[1]) if before else None
        for row in rows:
            if best is None or (row.ts_us, row.value) > best:
                best = (row.ts_us, row.value)
        expires = best[0] // 1000 + self.ttl_ms
        if (before and (before[0], before[1]) == best) or expires <= timerValues.getCurrentWatermarkInMs():
            return
        if before:
            self.handle.deleteTimer(before[2])
        self.held.update((*best, expires))
        self.handle.registerTimer(expires)
        yield self._change(key, "stored", *best, expires)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held and held[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield self._change(key, "expired", *held)

    def _change(self, key, change: str, ts_us: int, value: float, expires: int) -> Row:
        return Row(**{self.key: key[0], "change": change, "value": value, "ts_us": ts_us, "expires_ms": expires})


def newest_values(events: DataFrame, key: str, ttl_seconds: int, lateness: str = "5 minutes") -> DataFrame:
    """key and CHANGES: a row for each micro-batch that gives a key a newer value, and one when its value is over.

    ``events`` is a stream with key, value (double) and ts. Start it within ``state_on_disk``.
    """
    kind = events.schema[key].dataType.simpleString()
    given = events.withWatermark("ts", lateness).where(F.col(key).isNotNull() & F.col("value").isNotNull() & F.col("ts").isNotNull())
    rows = given.where(~F.isnan(F.col("value").cast("double"))).select(key, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("value").cast("double").alias("value"))
    return rows.groupBy(key).transformWithState(_Newest(key, 1000 * ttl_seconds), f"`{key}` {kind}, {CHANGES}", "append", "eventTime")


def held_values(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """key, value, ts_us, expires_ms that a stopped stream of ``newest_values`` holds; what was over by its watermark is gone."""
    with state_on_disk(spark):
        rows = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
        return rows.select(F.col(f"key.`{key}`").alias(key), "value.value", "value.ts_us", "value.expires_ms")


def replay(events: DataFrame, key: str, ttl_seconds: int, lateness: str, checkpoint: str, out: str) -> DataFrame:
    """Takes what a stream has by now, adds its changes to a table in ``out`` and returns the values held then."""
    spark = events.sparkSession
    with state_on_disk(spark):
        changes = newest_values(events, key, ttl_seconds, lateness)
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return held_values(spark, checkpoint, key)
