"""Event-time windows over events (ts, event_type, user_id, value), bounded or streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """`events` with `ts` as an instant, which event time needs; on a stream, late rows go after `watermark`."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", watermark) if watermark and events.isStreaming else out


def tumbling(events: DataFrame, size: str, slide: str | None = None, watermark: str | None = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per window; with `slide`, windows overlap."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    cents = F.sum(F.round(F.col("value") * 100).cast("long")) / 100.0
    out = timed(events, watermark).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), cents.alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap_seconds: int, watermark: str | None = "1 hour") -> DataFrame:
    """(user_id, start, n) of each run of a user's events less than the gap apart."""
    out = timed(events, watermark).groupBy(F.session_window("ts", f"{gap_seconds} seconds"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def distinct_events(events: DataFrame, keys: Sequence[str], watermark: str = "1 hour") -> DataFrame:
    """Each combination of `keys` once; on a stream, repeats within the watermark go and later ones come anew."""
    if events.isStreaming:
        return timed(events, watermark).dropDuplicatesWithinWatermark(list(keys)).select(*keys)
    return events.select(*keys).distinct()


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Score a stream with any stateless operator and append Parquet, once for all that is there."""
    return score(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
