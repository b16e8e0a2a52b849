"""Streaming forms of bars, alerts and session volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.operators.bars import ohlcv
from barflow.plans.portfolio import alerts


def tumbling(ticks: DataFrame, interval: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Bars of a fixed width from ticks (symbol, ts, seq, price, volume); with `slide`, overlapping windows."""
    win = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    return (
        ticks.withWatermark("ts", late).groupBy("symbol", win.alias("w")).agg(*ohlcv("price", F.struct("ts", "seq"), "volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def unique_bars(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (symbol, ts) once within the watermark; later repeats and late rows are dropped by the engine."""
    return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def sessions(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """Session volumes of the day so far (symbol, ts, volume)."""
    t, v = F.date_format("ts", "HHmm"), F.col("volume")
    part = lambda cond: F.sum(F.when(cond, v).otherwise(0.0))
    return (
        bars.withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 day").alias("w"))
        .agg(F.sum(v).alias("total_vol"), part((t >= "0930") & (t <= "1000")).alias("morning"), part((t > "1430") & (t < "1500")).alias("tail"))
        .select("symbol", F.to_date("w.start").alias("day"), "total_vol", "morning", "tail")
    )


def children_of(parents: DataFrame, kids: DataFrame, width: str, late: str = "2 days") -> DataFrame:
    """Stream-stream interval join: a child waits in state until its parent (start_ts, end_ts] arrives, and back.

    `width` is the longest a parent lasts (1 day, 7 days, 31 days, ...): it bounds how long state is kept."""
    p = parents.select(F.col("symbol").alias("p_symbol"), "start_ts", F.col("end_ts").alias("parent_end")).withWatermark("parent_end", late)
    c = kids.select("symbol", F.col("end_ts").alias("child_end")).withWatermark("child_end", late)
    on = (
        (F.col("symbol") == F.col("p_symbol")) & (F.col("child_end") > F.col("start_ts")) & (F.col("child_end") <= F.col("parent_end"))
        & (F.col("child_end") >= F.col("parent_end") - F.expr(f"INTERVAL {width}"))
    )
    return c.join(p, on).select("symbol", "child_end", "parent_end")


def price_alerts(quotes: DataFrame, positions: DataFrame) -> DataFrame:
    """Live quotes (symbol, ts, price) against stored positions (symbol, cost, qty)."""
    x = quotes.join(positions.select("symbol", "cost", "qty"), "symbol")
    gain = F.when(F.col("cost") > 0, (F.col("price") - F.col("cost")) / F.col("cost") * 100).otherwise(0.0)
    return x.withColumn("pnl_pct", F.round(gain, 2)).withColumn("alerts", alerts()).filter(F.size("alerts") > 0)


def to_folder(df: DataFrame, path: str, mode: str = "update") -> None:
    """Run an available-now stream; each micro-batch goes to its own folder, so a repeated batch overwrites itself."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")

    q = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of every key over all epochs."""
    df = spark.read.parquet(f"{path}/data")
    w = Window.partitionBy(*keys).orderBy(F.desc("epoch"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "epoch")
