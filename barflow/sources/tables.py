"""Given tables and the bar views derived from them.

`walk_bars` turns ticks into bars whose level is a running sum over the whole series. The running sum is
computed as an associative scan in three steps (ticks of one order range, order ranges of one day, days of
one symbol), so a symbol holding a third of all ticks is still spread over many tasks and only its rows of a day and
order range meet in one task: at most the days of the calendar times one for every 2^20 orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.operators.scan import numbered

ORDER_RANGE_BITS = 20
WALK_BASE = 100000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: Column | str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint") if isinstance(col, str) else F.round(col * 100).cast("bigint")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, seen as a trade of its supplier."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.to_date("l_shipdate").alias("day"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"),
        F.col("l_extendedprice").alias("px"),
        F.col("l_quantity").alias("qty"),
        F.col("l_tax").alias("tax"),
        F.col("l_discount").alias("disc"),
        F.col("l_returnflag").alias("flag"),
    )


def price_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV of the unit price: one partial aggregation, no window over ticks."""
    t = ticks(spark, sf_dir)
    price = cents(F.col("px") / F.col("qty"))
    order = F.struct("ok", "ln", "pk", "px")
    return (
        t.groupBy("symbol", "day")
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum("qty").alias("volume"),
            F.sum("px").alias("turnover"),
        )
        .withColumn("level", F.lit("day"))
    )


def second_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second market: the tick-price bars of every supplier under a five-digit code of its own."""
    b = price_bars(spark, sf_dir)
    return numbered(b.withColumn("symbol", F.concat(F.lit("hk"), F.lpad("symbol", 5, "0"))), F.trunc("day", "year"), "day")


def walk_bars(spark: SparkSession, sf_dir: str, order_range_bits: int = ORDER_RANGE_BITS) -> DataFrame:
    """Daily bars of the integer random walk driven by the ticks (see FIXTURES.md)."""
    t = ticks(spark, sf_dir).select(
        "symbol",
        "day",
        F.shiftright("ok", order_range_bits).alias("rng"),
        "ok",
        "ln",
        "pk",
        "px",
        "qty",
        (cents("px") % 401 - 200).alias("step"),
        F.round(F.col("tax") * 1000).cast("bigint").alias("up"),
        F.round(F.col("disc") * 1000).cast("bigint").alias("dn"),
    )
    grain = ["symbol", "day", "rng"]
    run = Window.partitionBy(*grain).orderBy("ok", "ln", "pk", "px").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        t.withColumn("post", F.sum("step").over(run))
        .withColumn("pre", F.col("post") - F.col("step"))
        .groupBy(*grain)
        .agg(
            F.sum("step").alias("move"),
            F.max(F.greatest("pre", "post") + F.col("up")).alias("hi"),
            F.min(F.least("pre", "post") - F.col("dn")).alias("lo"),
            F.sum("qty").alias("volume"),
            F.sum("px").alias("turnover"),
        )
        # by series at once: the windows and groups below are finer or the same, so they stay where the rows are
        .repartition("symbol")
    )
    before_range = Window.partitionBy("symbol", "day").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        ranges.withColumn("off", F.coalesce(F.sum("move").over(before_range), F.lit(0)))
        .groupBy("symbol", "day")
        .agg(
            F.sum("move").alias("move"),
            F.max(F.col("off") + F.col("hi")).alias("hi"),
            F.min(F.col("off") + F.col("lo")).alias("lo"),
            F.sum("volume").alias("volume"),
            F.sum("turnover").alias("turnover"),
        )
    )
    series = Window.partitionBy("symbol").orderBy("day")
    base = F.lit(WALK_BASE) + F.coalesce(
        F.sum("move").over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        days.withColumn("base", base)
        .withColumn("idx", F.row_number().over(series) - 1)
        .select(
            "symbol",
            F.lit("day").alias("level"),
            "day",
            "idx",
            F.col("base").cast("double").alias("open"),
            (F.col("base") + F.col("hi")).cast("double").alias("high"),
            (F.col("base") + F.col("lo")).cast("double").alias("low"),
            (F.col("base") + F.col("move")).cast("double").alias("close"),
            F.col("volume"),
            F.col("turnover"),
        )
    )


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event values, one series per event type."""
    from barflow.operators.bars import resample

    ev = load(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
    )
    return resample(ev, "1 hour", price="price", seq="seq").withColumn("level", F.lit("60m"))


def quotes(bars: DataFrame) -> DataFrame:
    """Last bar per symbol with its change against the close before, as one aggregation of two bars."""
    last2 = F.sort_array(F.collect_list(F.struct("idx", "day", "close", "volume", "open")), asc=False)
    w = Window.partitionBy("symbol")
    tail = bars.withColumn("n", F.max("idx").over(w)).filter(F.col("idx") >= F.col("n") - 1)
    return (
        tail.groupBy("symbol")
        .agg(last2.alias("b"))
        .select(
            "symbol",
            F.col("b")[0]["day"].alias("day"),
            F.col("b")[0]["close"].alias("price"),
            F.col("b")[0]["open"].alias("open"),
            F.col("b")[0]["volume"].alias("volume"),
            F.round(
                F.when(F.size("b") > 1, (F.col("b")[0]["close"] / F.col("b")[1]["close"] - 1) * 100).otherwise(0.0), 4
            ).alias("change_pct"),
        )
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with name, sector (nation) and parent sector (region)."""
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey, "left")
        .join(r, n.n_regionkey == r.r_regionkey, "left")
        .select(
            F.col("s_suppkey").cast("string").alias("symbol"),
            F.col("s_name").alias("name"),
            F.coalesce("n_name", F.lit("other")).alias("sector"),
            F.coalesce("r_name", F.lit("other")).alias("parent"),
        )
    )


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`a|b|c` list per symbol: sorted distinct brands of its five most frequent parts."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), "l_partkey")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    counts = li.groupBy("symbol", "l_partkey").count().join(p, F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("symbol").orderBy(F.desc("count"), "p_brand", "p_partkey")
    return (
        counts.withColumn("rn", F.row_number().over(w))
        .filter("rn <= 5")
        .groupBy("symbol")
        .agg(F.array_join(F.sort_array(F.collect_set("p_brand")), "|").alias("themes"))
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        k.alias("code"),
        F.col("p_name").alias("name"),
        (5 + F.col("p_size")).cast("double").alias("pe"),
        (F.col("p_size") / 10).alias("pb"),
        (k % 35).cast("double").alias("roe"),
        (k % 70).cast("double").alias("gross_margin"),
        (k * 7 % 90).cast("double").alias("debt_ratio"),
        (k * 13 % 50 - 10).cast("double").alias("revenue_growth"),
        (F.col("p_size") % 6).cast("double").alias("dividend_yield"),
        F.col("p_retailprice").alias("market_cap"),
        (k % 3 - 1).cast("double").alias("fcf"),
        (k % 11).cast("double").alias("cash"),
        (k % 7).cast("double").alias("debt"),
        (k % 5 - 2).cast("double").alias("operating_cf"),
    )


def positions(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """One position per customer; cost is the close 20 bars before the end of its symbol."""
    n_sup = load(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    w = Window.partitionBy("symbol")
    cost = (
        bars.withColumn("n", F.max("idx").over(w))
        .filter(F.col("idx") == F.col("n") - 20)
        .select("symbol", F.col("close").alias("cost"))
    )
    return (
        load(spark, sf_dir, "customer")
        .crossJoin(F.broadcast(n_sup))
        .select(
            "c_custkey",
            F.col("c_name").alias("name"),
            (F.col("c_custkey") % F.col("n")).cast("string").alias("symbol"),
            (1 + F.col("c_custkey") % 9).alias("qty"),
        )
        .join(cost, "symbol", "left")
    )
