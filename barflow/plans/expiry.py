"""Expiry histograms of items that count time in 30-second epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# First epoch and epoch length.
GENESIS = "2020-10-15 14:30:00"
EPOCH_SECONDS = 30


def epoch_day(epoch: Column) -> Column:
    start = F.unix_timestamp(F.lit(GENESIS))
    return F.to_date(F.timestamp_seconds(start + epoch * EPOCH_SECONDS))


def histogram(days: DataFrame) -> DataFrame:
    """Rows per day and the day holding the upper median. Days are bounded by the calendar, so the running count
    is a small window over the already aggregated histogram."""
    h = days.groupBy("day").agg(F.count("*").alias("n"))
    total = h.agg(F.sum("n").alias("total"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    c = h.withColumn("cum", F.sum("n").over(run)).crossJoin(F.broadcast(total))
    half = F.floor(F.col("total") / 2)
    return c.select("day", "n", ((F.col("cum") > half) & (F.col("cum") - F.col("n") <= half)).alias("is_median"))
