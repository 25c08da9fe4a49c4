"""Structured Streaming forms: counts in sliding windows, late rows, duplicates within a watermark (latest rows by key: ``keyed``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, time: str = "ts", keys: Sequence[str] = ("event_type",), width: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts per key in sliding windows; events later than *late* are left out."""
    w = F.window(time, width, slide)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def distinct_events(events: DataFrame, keys: Sequence[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))

