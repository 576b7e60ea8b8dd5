"""Streaming twins of batch aggregations: late rows within the watermark still count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_stats(stream: DataFrame, key: list[str], value: str, time: str = "time", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and extremes of each window and key, of a stream or a batch."""
    timed = stream.withWatermark(time, late) if stream.isStreaming else stream
    found = timed.groupBy(F.window(time, length), *key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return found.select(F.col("window.start").alias("start"), *key, "n", "mean", "low", "high")


def exceedances(stream: DataFrame, key: list[str], value: str, threshold: float, time: str = "time", length: str = "1 day", late: str = "1 day") -> DataFrame:
    """How many values of each window lie strictly above a threshold."""
    timed = stream.withWatermark(time, late) if stream.isStreaming else stream
    return timed.groupBy(F.window(time, length), *key).agg(F.count_if(F.col(value) > threshold).alias("n")).select(F.col("window.start").alias("start"), *key, "n")
