"""Reductions over event time, for streams and for tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A


def tumbling(events: DataFrame, time: str, value: str, by: list[str], width: str, late: str = "1 hour") -> DataFrame:
    """count, sum, mean and extremes of each window and key; rows later than ``late`` are left out on a stream."""
    rows = events.withColumn("_time", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_time", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("_time", width), *by).agg(F.count(F.lit(1)).alias("n"), A.nansum(value).alias("total"), A.nanmean(value).alias("mean"), A.nanmin(value).alias("low"), A.nanmax(value).alias("high"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total", "mean", "low", "high")


def histogram(events: DataFrame, time: str, value: str, edges: list[float], width: str, late: str = "1 hour") -> DataFrame:
    """Counts of each window's values by bin."""
    from ..operators.histograms import bin_of

    rows = events.withColumn("_time", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_time", late) if events.isStreaming else rows
    rows = rows.withColumn("bin", bin_of(F.col(value), edges)).filter("bin is not null")
    return rows.groupBy(F.window("_time", width), "bin").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "bin", "n")
