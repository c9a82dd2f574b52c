"""Windowed aggregation for batch and streaming DataFrames alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _watched(df: DataFrame, time: str, late: str | None) -> DataFrame:
    return df.withWatermark(time, late) if late and df.isStreaming else df


def _finish(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    return df.agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggs)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], aggs: dict[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates by key and fixed window; rows later than ``late`` are dropped when streaming."""
    return _finish(_watched(df, time, late).groupBy(F.window(time, width).alias("w"), *keys), keys, aggs)


def sliding(df: DataFrame, time: str, width: str, slide: str, keys: list[str], aggs: dict[str, Column], late: str | None = None) -> DataFrame:
    return _finish(_watched(df, time, late).groupBy(F.window(time, width, slide).alias("w"), *keys), keys, aggs)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggs: dict[str, Column], late: str | None = None) -> DataFrame:
    """Windows that end after ``gap`` without a row of their key."""
    return _finish(_watched(df, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys), keys, aggs)


def distinct_within(df: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key; when streaming, within the watermark."""
    if df.isStreaming:
        return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def refresh_on_arrival(stream: DataFrame, checkpoint: str, refresh: Callable[[DataFrame, int], None]):
    """Calls ``refresh(batch, number)`` for each micro-batch, as an incremental view needs."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(refresh).trigger(availableNow=True).start()
