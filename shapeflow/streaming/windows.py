"""Windowed counts of an event stream: the streaming form of the series builder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, key: str, ts: str = "ts", size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(key, start, n, value) of tumbling or sliding windows, final once the watermark has passed."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withWatermark(ts, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return g.select(key, F.col("w.start").alias("start"), "n", "value")
