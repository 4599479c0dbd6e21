"""Streaming forms of the bar rollups: tumbling right-closed buckets and daily bars, late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(bars: DataFrame, minutes: int = 5, late: str = "1 hour") -> DataFrame:
    """symbol, timestamp (bucket end), open, high, low, close, volume; emitted once the watermark passes the bucket.

    The window is shifted by a microsecond, so that a bar on an edge closes its bucket.
    """
    shifted = F.col("timestamp") - F.expr("interval 1 microsecond")
    ts = F.col("timestamp")
    g = bars.withColumn("shifted", shifted).withWatermark("shifted", late).groupBy("symbol", F.window("shifted", f"{minutes} minutes")).agg(F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"))
    return g.select("symbol", F.col("window.end").alias("timestamp"), "open", "high", "low", "close", "volume")


def streaming_daily(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """ticker, date, close_price, volume per finished day."""
    g = bars.withWatermark("timestamp", late).groupBy(F.col("symbol").alias("ticker"), F.window("timestamp", "1 day")).agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("timestamp"))).alias("close_price"), F.sum("volume").alias("volume"))
    return g.select("ticker", F.to_date(F.col("window.start")).alias("date"), "close_price", "volume")
