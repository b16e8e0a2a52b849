"""Volume inside the trading day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_shares(bars: DataFrame) -> DataFrame:
    """Shares of the opening half hour, mid-morning, afternoon and tail in the day's volume, in percent.

    10:00 belongs to the opening; a 15:00 bar counts in the total but in no share.
    """
    t, v = F.col("time"), F.col("volume")
    part = lambda cond: F.sum(F.when(cond, v).otherwise(0.0)) / F.sum(v) * 100
    return (
        bars.groupBy("symbol", "day")
        .agg(
            F.sum(v).alias("total_vol"),
            part((t >= "0930") & (t <= "1000")).alias("morning_pct"),
            part((t > "1000") & (t <= "1130")).alias("mid_pct"),
            part((t >= "1300") & (t <= "1430")).alias("afternoon_pct"),
            part((t > "1430") & (t < "1500")).alias("tail_pct"),
            F.count("*").alias("bars_count"),
        )
        .filter("total_vol > 0")
    )


def top_volume(bars: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("symbol", "day").orderBy(F.desc("volume"), "time")
    return bars.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
