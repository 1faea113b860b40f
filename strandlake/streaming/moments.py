"""Incremental moment statistics with Structured Streaming.

The aggregates' state is a few mergeable central-moment doubles for each key, so a stream of new frames updates
profiles without the old frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ensemble import moments


def streaming_moments(stream: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Moments and bimodality of ``x`` by ``keys`` over all rows so far (output mode complete or update)."""
    return moments(stream, keys, x)


def windowed_moments(stream: DataFrame, time: str, width: str, late: str, keys: list[str], x: str) -> DataFrame:
    """Moments by event-time window and ``keys``; rows later than the watermark are left out."""
    s = stream.withWatermark(time, late).withColumn("window", F.window(time, width))
    return moments(s, ["window", *keys], x)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process all that is there into the in-memory table ``name`` and stop."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
