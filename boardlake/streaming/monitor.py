"""Error-code and latency monitor per tumbling window, and its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlake.operators.metrics import count_of


def monitor(results: DataFrame, time: str, width: str, code: str, latency: str) -> DataFrame:
    """Per window and code: results, latency sum and maximum. Works on batch and stream."""
    return (results.groupBy(F.window(time, width).alias("_w"), code)
            .agg(F.count("*").alias("results"), F.round(F.sum(latency), 6).alias("latency_sum"),
                 F.max(latency).alias("latency_max"), count_of(F.col(latency) > 100).alias("slow"))
            .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), code,
                    "results", "latency_sum", "latency_max", "slow"))


def stream_monitor(stream: DataFrame, time: str, width: str, delay: str, code: str, latency: str) -> DataFrame:
    """Same aggregation behind a watermark: late rows are dropped, closed windows are final."""
    return monitor(stream.withWatermark(time, delay), time, width, code, latency)
