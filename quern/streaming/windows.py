"""Event-time windows with late data, an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, at: str, size: str, slide: str | None, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` are dropped by the watermark."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    """Activity of each key in sessions that end after ``gap`` without a row."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("window"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def deduplicated(stream: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
