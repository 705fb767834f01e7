"""Running rankings over a stream of scored rows, with event time and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scores(scores: DataFrame, time: str = "ts", window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Weighted mean of each forecaster and event-time window; batch or stream."""
    x = scores.withWatermark(time, late) if scores.isStreaming else scores
    span = F.window(time, window, slide) if slide else F.window(time, window)
    x = x.groupBy(span.alias("w"), "forecaster").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("weight"), F.count("*").alias("n"))
    return x.select(F.col("w.start").alias("window_start"), "forecaster", F.try_divide("s", "weight").alias("score"), "n")


def sessions(scores: DataFrame, time: str = "ts", gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    x = scores.withWatermark(time, late) if scores.isStreaming else scores
    return x.groupBy(F.session_window(time, gap).alias("w"), "forecaster").agg(F.avg("score").alias("score"), F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "forecaster", "score", "n")


def first_forecasts(rows: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """The first row of each forecast id within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["forecast_id"]) if rows.isStreaming else rows.dropDuplicates(["forecast_id"])
