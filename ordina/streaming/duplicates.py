"""Repeated messages in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_seen_stream(stream: DataFrame, message: list[str], event_time: str, horizon: str = "1 hour") -> DataFrame:
    """The first of equal messages within ``horizon`` of event time; state is dropped beyond it.

    Works on batch frames as well, where it keeps one row of each message.
    """
    if not stream.isStreaming:
        return stream.dropDuplicates(message)
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(message)
