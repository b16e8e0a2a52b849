"""Bars: resampling, cleaning, numbering, quarantine and level relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Interval names of the levels from fine to coarse.
LEVELS = ["1s", "3s", "5s", "10s", "15s", "20s", "30s", "1m", "3m", "5m", "10m", "15m", "30m", "60m",
          "day", "week", "month", "quarter", "year"]
# Length of the fixed-width levels as Spark intervals.
LEVEL_INTERVAL = {"1s": "1 second", "3s": "3 seconds", "5s": "5 seconds", "10s": "10 seconds", "15s": "15 seconds",
                  "20s": "20 seconds", "30s": "30 seconds", "1m": "1 minute", "3m": "3 minutes", "5m": "5 minutes",
                  "10m": "10 minutes", "15m": "15 minutes", "30m": "30 minutes", "60m": "1 hour", "day": "1 day"}


def check_level_order(levels: list[str]) -> None:
    ranks = [LEVELS.index(lv) for lv in levels]
    if any(b >= a for a, b in zip(ranks, ranks[1:])):
        raise ValueError(f"levels must go from coarse to fine: {levels}")


def ohlcv(price: str, order: Column, volume: str) -> list[Column]:
    """Aggregates of one bar; all of them combine on the map side."""
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"),
    ]


def resample(ticks: DataFrame, interval: str, price: str = "price", seq: str = "seq", volume: str = "volume") -> DataFrame:
    """Ticks (symbol, ts, seq, price, volume) to bars of one fixed-width level."""
    order = F.struct("ts", seq)
    return (
        ticks.groupBy("symbol", F.window("ts", interval)["start"].alias("ts")).agg(*ohlcv(price, order, volume))
    )


def resample_level(ticks: DataFrame, level: str, **cols: str) -> DataFrame:
    """Like `resample` with a level name; week and longer levels follow the calendar."""
    if level in LEVEL_INTERVAL:
        return resample(ticks, LEVEL_INTERVAL[level], **cols).withColumn("level", F.lit(level))
    order = F.struct("ts", cols.get("seq", "seq"))
    return (
        ticks.groupBy("symbol", F.date_trunc(level, "ts").alias("ts"))
        .agg(*ohlcv(cols.get("price", "price"), order, cols.get("volume", "volume")))
        .withColumn("level", F.lit(level))
    )


def roll_up(bars: DataFrame, unit: str, ts: str = "ts") -> DataFrame:
    """Bars to bars of a coarser calendar level."""
    return bars.groupBy("symbol", F.date_trunc(unit, ts).alias("ts")).agg(
        F.min_by("open", ts).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"),
    )


def sane_low() -> Column:
    return F.least("low", "open", "high", "close")


def sane_high() -> Column:
    return F.greatest("low", "open", "high", "close")


def autofix(bars: DataFrame) -> DataFrame:
    """Widen the range so that it covers open and close."""
    return bars.withColumns({"low": sane_low(), "high": sane_high()})


def insane(bars: DataFrame) -> DataFrame:
    """Side output of bars whose range does not cover open and close."""
    return bars.filter((F.col("low") > sane_low()) | (F.col("high") < sane_high()))


def bar_end(ts: str = "ts", level: str = "level") -> Column:
    """Bars stamped with a bare date end at 23:59."""
    t = F.col(ts).cast("timestamp")
    bare = (F.hour(t) == 0) & (F.minute(t) == 0) & F.col(level).isin(LEVELS[LEVELS.index("day"):])
    return F.when(bare, t + F.expr("INTERVAL 23 HOURS 59 MINUTES")).otherwise(t)


def out_of_order(bars: DataFrame, arrival: str, ts: str = "ts", range_bits: int = 16) -> DataFrame:
    """Rows whose time does not exceed every earlier arrival of the series.

    Arrivals are cut into ranges: the maximum before a range comes from one row per range, the rest from a
    window inside the range, so no series is gathered in one task.
    """
    x = bars.withColumn("_rng", F.shiftright(F.col(arrival).cast("bigint"), range_bits))
    before = Window.partitionBy("symbol").orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    tops = x.groupBy("symbol", "_rng").agg(F.max(ts).alias("_top")).select("symbol", "_rng", F.max("_top").over(before).alias("_base"))
    inside = Window.partitionBy("symbol", "_rng").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return (
        x.withColumn("_in", F.max(ts).over(inside))
        .join(tops, ["symbol", "_rng"])
        .withColumn("prev_ts", F.greatest("_base", "_in"))
        .filter(F.col(ts) <= F.col("prev_ts"))
        .drop("_rng", "_base", "_in")
    )


def long_enough(bars: DataFrame, k: int) -> DataFrame:
    """Keep series with at least `k` bars. The count is pre-aggregated, so no series meets in one task."""
    ok = bars.groupBy("symbol").count().filter(F.col("count") >= k).select("symbol")
    return bars.join(ok, "symbol", "left_semi")


def fresh(bars: DataFrame, as_of: Column, days: int = 15, day: str = "day") -> DataFrame:
    """Drop series whose last bar is older than `days`."""
    last = bars.groupBy("symbol").agg(F.max(day).alias("last_day")).filter(F.datediff(as_of, F.col("last_day")) <= days)
    return bars.join(last.select("symbol"), "symbol", "left_semi")


def last_n(bars: DataFrame, n: int = 250, order: str = "day") -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc(order))
    return bars.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def first_source(bars: DataFrame, min_bars: int = 30) -> DataFrame:
    """Per symbol keep only the best-ranked source that holds at least `min_bars` bars."""
    best = (
        bars.groupBy("symbol", "src_rank")
        .count()
        .filter(F.col("count") >= min_bars)
        .groupBy("symbol")
        .agg(F.min("src_rank").alias("src_rank"))
    )
    return bars.join(best, ["symbol", "src_rank"])


def live_close(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """Replace the close of the last bar of each series by the live price where there is one."""
    last = bars.groupBy("symbol").agg(F.max("idx").alias("last_idx"))
    q = quotes.select("symbol", F.col("price").alias("live"))
    info = last.join(q, "symbol", "left")
    return (
        bars.join(info, "symbol", "left")
        .withColumn(
            "close",
            F.when((F.col("idx") == F.col("last_idx")) & (F.col("live") > 0), F.col("live")).otherwise(F.col("close")),
        )
        .drop("last_idx", "live")
    )


def children(parents: DataFrame, kids: DataFrame) -> DataFrame:
    """Interval join: a child belongs to the first parent whose end is at or after its own end.

    No range join: both sides are merged and the parent's end is filled backwards inside each (symbol, day).
    A child with no later parent that day takes the first parent of the next day that has one, which comes
    from a table of one row per (symbol, day). Children after the last parent keep a null parent.
    """
    p = parents.select("symbol", F.col("end_ts").alias("at"), F.lit(1).alias("is_parent"), F.lit(None).cast("timestamp").alias("ts"))
    c = kids.select("symbol", F.col("end_ts").alias("at"), F.lit(0).alias("is_parent"), "ts")
    both = p.unionByName(c).withColumn("bkt", F.to_date("at"))
    own_end = F.when(F.col("is_parent") == 1, F.col("at"))
    later = Window.partitionBy("symbol").orderBy("bkt").rowsBetween(1, Window.unboundedFollowing)
    spill = (
        both.groupBy("symbol", "bkt")
        .agg(F.min(own_end).alias("first_end"))
        .select("symbol", "bkt", F.first("first_end", ignorenulls=True).over(later).alias("next_end"))
    )
    inside = (
        Window.partitionBy("symbol", "bkt")
        .orderBy("at", "is_parent")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    return (
        both.withColumn("same_day", F.first(own_end, ignorenulls=True).over(inside))
        .filter("is_parent = 0")
        .join(spill, ["symbol", "bkt"])
        .select("symbol", "ts", F.col("at").alias("end_ts"), F.coalesce("same_day", "next_end").alias("parent_end"))
    )
