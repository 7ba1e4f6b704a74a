"""Streaming twins of the gates: the same step functions over Structured Streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throttle_stream(events: DataFrame, keys: list[str], seconds: int, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(event_id, accepted) of a stream: the throttle of the batch gate, its state dropped once the key has been quiet.

    State per key is one number. Events of a batch are taken in time order; a key's state expires when the watermark
    has passed its last accepted event by the gate's length, after which it could not refuse anything any more.
    """
    gap = seconds * 1_000_000

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        flags = []
        for us in rows["us"]:
            ok = last is None or us - last >= gap
            last = int(us) if ok else last
            flags.append(ok)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[["event_id"]].assign(accepted=flags)

    x = events.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", delay)
    x = x.select(*keys, "event_id", "_time", F.unix_micros("_time").alias("us"))
    kind = dict(x.dtypes)["event_id"]
    return x.groupBy(*keys).applyInPandasWithState(run, f"event_id {kind}, accepted boolean", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def first_by_address(pages: DataFrame, delay: str = "1 day", ts: str = "fetched_at") -> DataFrame:
    """The first page of each address within the watermark: level-one duplicates of a stream."""
    from carda.operators.dedup import url_key

    x = pages.withColumn("_time", F.col(ts).cast("timestamp")).withColumn("url_key", url_key(F.col("source_url")))
    return x.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["url_key"]).drop("_time")


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(hour, event_type, n) of a stream, late events up to ``delay`` counted."""
    x = events.withColumn("_time", F.col("ts").cast("timestamp")).withWatermark("_time", delay)
    return x.groupBy(F.window("_time", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
