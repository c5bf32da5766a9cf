"""Moments of a stream: the one-pass statistics kept up to date as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, value: str, by: str, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, by, n, mean, std) of a stream with a watermark; also of a table."""
    x = F.col(value)
    rows = events.withWatermark(time, late).groupBy(F.window(time, width), by)
    sums = rows.agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    mean = F.col("s") / F.col("n")
    return sums.select("window", by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(1e-6))).alias("std"))
