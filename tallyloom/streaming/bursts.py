"""Burst counts over a stream whose event time is availability: what is late never changes what was counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, platform: str, available: str, minutes: int = 15, slide_minutes: int = 5, late: str = "0 seconds") -> DataFrame:
    """(platform, start, end, n) of windows that slide over a stream; a row later than the watermark is dropped."""
    at = events.select(F.col(platform).alias("platform"), F.col(available).cast("timestamp").alias("at")).withWatermark("at", late)
    frame = F.window("at", f"{minutes} minutes", f"{slide_minutes} minutes").alias("frame")
    return at.groupBy("platform", frame).agg(F.count("*").alias("n")).select("platform", F.col("frame.start").alias("start"), F.col("frame.end").alias("end"), "n")


def first_copies(events: DataFrame, key: str, available: str, late: str = "1 hour") -> DataFrame:
    """The stream without repeats of a key, as far back as the watermark goes."""
    return events.withWatermark(available, late).dropDuplicatesWithinWatermark([key])
