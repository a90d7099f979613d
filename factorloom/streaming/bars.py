"""Bars and sessions of a stream of events: the batch definitions with watermarks for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_bars(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Minute bars of (event_type, ts, event_id, value); a bar is final once the watermark passes its minute."""
    order = F.struct("ts", "event_id")
    bars = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount")
    )
    return bars.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("datetime"), "open", "high", "low", "close", "volume", "amount")


def sessions(events: DataFrame, gap: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """One row per session of a symbol: a session ends when no event comes for the gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), F.col("event_type").alias("symbol")).agg(F.count("*").alias("events"), F.sum("value").alias("amount"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select("symbol", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "events", "amount")
