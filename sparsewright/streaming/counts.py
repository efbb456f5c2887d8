"""Streaming counts of cells and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, cell: str, feature: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(begin, cell, feature, value) in tumbling windows, late rows dropped behind the watermark. Works on streams and tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size), cell, feature).agg(F.count(F.lit(1)).alias("value")).select(F.col("window.start").alias("begin"), F.col(cell).alias("cell"), F.col(feature).alias("feature"), "value")


def start_counts(events: DataFrame, sink: str, checkpoint: str, **columns):
    """Append finished windows to a Parquet folder; restarts from its checkpoint."""
    return windowed_counts(events, **columns).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
