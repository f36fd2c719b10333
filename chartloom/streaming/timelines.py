"""Continuous upkeep of timelines from a stream of events (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per key and window; windows close when the watermark passes them."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n_events")).select("window.start", *keys, "n_events")


def first_deliveries(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events without repeats of their keys within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
