"""Event logs as streams: the batch transforms with watermarks, and state where a stream needs it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tumbling(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and their value by type in windows that don't overlap; works on a stream and on a table."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", every).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "cents")
    )


def without_repeats(events: DataFrame, key: str = "event_id", within: str = "1 hour") -> DataFrame:
    """Events whose key wasn't seen in the time before; state is dropped with the watermark."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A row for each run of a user's events with no pause as long as ``gap``."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n_events"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
    )


def summary(events: DataFrame) -> DataFrame:
    """Events by type, for complete or update mode."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("about_users"))


class _Kept(StatefulProcessor):
    """A key's value, until its time is over; asked for once for each batch in which the key has none."""

    def __init__(self, look_up: Callable[[object], str | None], ttl_ms: int):
        self.look_up, self.ttl_ms = look_up, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hit = self.value.exists()
        found = self.value.get()[0] if hit else self.look_up(key[0])
        if not hit:
            self.value.update((found,))
        for frame in rows:
            yield pd.DataFrame({"key": frame["key"], "value": pd.Series([found] * len(frame), dtype=object), "hit": hit})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, key: str, look_up: Callable[[object], str | None], ttl_s: int = 3600) -> DataFrame:
    """``key, value, hit`` for a stream of requests: ``look_up``'s answer, kept as state for ``ttl_s`` seconds (null too).

    The state needs the RocksDB provider (``spark.sql.streaming.stateStore.providerClass``). A key's requests of one
    batch are read in Arrow batches, so a hot key takes time and no memory. The clock gives the stream batches without
    rows, so it runs until it is stopped.
    """
    rows = requests.select(F.col(key).alias("key"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.groupBy("key").transformWithStateInPandas(_Kept(look_up, ttl_s * 1000), f"key {kind}, value string, hit boolean", "append", "processingTime")
    return found.withColumnRenamed("key", key)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Work through what is there and stop; the checkpoint makes a second call go on where the first ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
