"""Market context: sectors, futures seats, macro series, short interest, warrants and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.functions import labels as L
from barflow.functions.rules import clamp, present
from barflow.sources import tables as T


# ---- sectors --------------------------------------------------------------------------------------------------


def sector_heat(quotes: DataFrame, members: DataFrame) -> DataFrame:
    """Mean change, up and down counts and a 0-100 heat per sector of (sector, symbol)."""
    up = F.count_if(F.col("change_pct") > 0)
    n = F.count("*")
    return (
        quotes.join(members.select("symbol", "sector"), "symbol")
        .groupBy("sector")
        .agg(
            F.round(F.avg("change_pct"), 2).alias("chg"),
            up.alias("up"),
            (n - up).alias("dn"),
            clamp((F.lit(50) + F.avg("change_pct") * 10 + up / n * 30).cast("int")).alias("score"),
        )
    )


def sector_leaders(pool: DataFrame, k: int = 5) -> DataFrame:
    """Mean change and the k strongest symbols of each sector. The rank filter runs before the shuffle too, so no
    sector is gathered whole."""
    w = Window.partitionBy("sector").orderBy(F.desc("change_pct"), "symbol")
    top = pool.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    names = top.groupBy("sector").agg(F.array_sort(F.collect_list(F.struct("_rn", "symbol"))).alias("t"))
    means = pool.groupBy("sector").agg(F.round(F.avg("change_pct"), 2).alias("sector_chg"))
    return means.join(names, "sector").select("sector", "sector_chg", F.transform("t", lambda x: x["symbol"]).alias("leading"))


def heat_or_inferred(direct: DataFrame, inferred: DataFrame, min_rows: int = 10) -> DataFrame:
    """The direct table when it has more than `min_rows` rows, else the heat inferred from members."""
    n = F.broadcast(direct.agg(F.count("*").alias("n_direct")))
    a = direct.crossJoin(n).filter(F.col("n_direct") > min_rows).drop("n_direct")
    b = inferred.crossJoin(n).filter(F.col("n_direct") <= min_rows).drop("n_direct")
    return a.unionByName(b, allowMissingColumns=True)


def sector_signal() -> dict[str, Column]:
    """Signal class and up ratio of a stock's sector; neutral when there is no heat."""
    total = F.greatest(F.coalesce("up", F.lit(0)) + F.coalesce("dn", F.lit(0)), F.lit(1))
    ratio = F.coalesce("up", F.lit(0)) / total * 100
    word = (
        F.when(F.col("chg").isNull(), L.SECTOR_NONE).when((F.col("chg") > 2) & (ratio > 60), L.SECTOR_LEAD)
        .when(F.col("chg") > 0, L.SECTOR_STRONG).when(F.col("chg") > -2, L.SECTOR_FLAT).otherwise(L.SECTOR_WEAK)
    )
    return {
        "sector_signal": word,
        "up_ratio": F.when(F.col("chg").isNull(), 0.0).otherwise(ratio),
        "avg_chg": F.coalesce("chg", F.lit(0.0)),
        "sector_score": F.coalesce("score", F.lit(50)),
    }


def breadth(quotes: DataFrame, limit: float = -9.9) -> DataFrame:
    return quotes.agg(
        F.count_if(F.col("change_pct") > 0).alias("up_count"),
        F.count_if(F.col("change_pct") < 0).alias("down_count"),
        F.count("*").alias("total_count"),
        F.count_if(F.col("change_pct") <= limit).alias("limit_down_count"),
    )


# ---- futures --------------------------------------------------------------------------------------------------


def seats(spark: SparkSession, sf: str) -> DataFrame:
    """Seat table derived from the line items: one row per (day, variety, contract)."""
    li = T.load(spark, sf, "lineitem")
    return li.groupBy(
        F.to_date("l_shipdate").alias("day"),
        F.col("l_returnflag").alias("variety"),
        F.when(F.col("l_linestatus") == "F", F.concat("l_returnflag", F.lit("综合"))).otherwise(F.concat("l_returnflag", F.col("l_linenumber"))).alias("contract"),
    ).agg(
        F.sum(F.col("l_quantity") * 10).cast("bigint").alias("long_oi"),
        F.sum(F.col("l_linenumber") * 60).cast("bigint").alias("short_oi"),
    )


def net_positions(seats: DataFrame) -> DataFrame:
    """Per variety the latest day against the day before; the aggregate contract wins, else the last one."""
    whole = F.contains(F.col("contract"), F.lit("综合")).cast("int")
    daily = seats.groupBy("variety", "day").agg(
        F.max_by(F.struct("long_oi", "short_oi"), F.struct(whole, F.col("contract"))).alias("p")
    )
    days = seats.select("day").distinct().orderBy(F.desc("day")).limit(2)
    rank = days.withColumn("k", F.row_number().over(Window.orderBy(F.desc("day"))))
    two = daily.join(F.broadcast(rank), "day")
    now, before = F.when(F.col("k") == 1, F.col("p")), F.when(F.col("k") == 2, F.col("p"))
    w = two.groupBy("variety").agg(F.first(now, True).alias("n"), F.first(before, True).alias("b")).filter("n IS NOT NULL")
    lchg = F.coalesce(F.col("n.long_oi") - F.col("b.long_oi"), F.lit(0))
    schg = F.coalesce(F.col("n.short_oi") - F.col("b.short_oi"), F.lit(0))
    net_chg = lchg - schg
    return w.select(
        "variety", F.col("n.long_oi").alias("long_oi"), F.col("n.short_oi").alias("short_oi"),
        (F.col("n.long_oi") - F.col("n.short_oi")).alias("net"), lchg.alias("long_chg"), schg.alias("short_chg"),
        net_chg.alias("net_chg"),
        F.when(net_chg > 1000, L.LONG).when(net_chg < -1000, L.SHORT).otherwise(L.NEUTRAL).alias("direction"),
    )


def futures_for_stocks(stock_types: DataFrame, futures: DataFrame) -> DataFrame:
    """Majority trend of the futures tied to a stock type; (stock_type, tag) against (tag, trend)."""
    ups = F.count_if(F.col("trend") == "↑")
    n = F.count("tag2")
    return (
        stock_types.join(futures.select(F.col("tag").alias("tag2"), "trend"), F.col("tag") == F.col("tag2"), "left")
        .groupBy("stock_type")
        .agg(n.alias("n"), ups.alias("ups"))
        .withColumn(
            "summary",
            F.when(F.col("n") == 0, "无相关期货数据").when(F.col("ups") > F.col("n") / 2, L.LONG)
            .when(F.col("ups") < F.col("n") / 2, L.SHORT).otherwise(L.NEUTRAL),
        )
    )


# ---- macro ----------------------------------------------------------------------------------------------------

# Which derived series plays which macro role, and its scale.
ROLES = {"AFRICA": ("DXY", 2500.0), "AMERICA": ("VIX", 12000.0), "ASIA": ("US10Y", 55000.0),
         "EUROPE": ("US3M", 60000.0), "MIDDLE EAST": ("USDCNY", 35000.0)}


def macro_series(spark: SparkSession, sf: str) -> DataFrame:
    """One daily series per region: mean order value, scaled to the range of its role."""
    o, cu, n, r = (T.load(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    name = F.col("r_name")
    role, scale = F.lit(None).cast("string"), F.lit(1.0)
    for k, (role_name, s) in ROLES.items():
        role, scale = F.when(name == k, role_name).otherwise(role), F.when(name == k, s).otherwise(scale)
    dim = cu.join(n, cu.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("c_custkey").alias("o_custkey"), F.coalesce(role, name).alias("name"), scale.alias("scale")
    )
    return (
        o.select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
        .join(dim, "o_custkey")
        .groupBy("name", "day")
        .agg((F.avg("o_totalprice") / F.first("scale")).alias("close"), (F.max("o_totalprice") / F.first("scale")).alias("high"), (F.min("o_totalprice") / F.first("scale")).alias("low"))
    )


def macro_summary(series: DataFrame) -> DataFrame:
    """Last value, change against the 5th and 20th last value, arrow; series with under 2 points are dropped."""
    w = Window.partitionBy("name").orderBy(F.desc("day"))
    tail = series.withColumn("k", F.row_number().over(w)).filter("k <= 20")
    at = lambda k, col="close": F.max(F.when(F.col("k") == k, F.col(col)))
    a = tail.groupBy("name").agg(
        at(1).alias("px"), F.coalesce(at(5), at(1)).alias("px5"), F.coalesce(at(20), at(1)).alias("px20"),
        at(1, "high").alias("hi"), at(1, "low").alias("lo"), F.count("*").alias("n"),
    )
    return a.filter("n >= 2").select(
        "name", F.round("px", 2).alias("value"), F.round((F.col("px") - F.col("px5")) / F.col("px5") * 100, 2).alias("chg_5d"),
        F.round((F.col("px") - F.col("px20")) / F.col("px20") * 100, 2).alias("chg_20d"),
        F.when(F.col("px") > F.col("px20"), "↑").otherwise("↓").alias("trend"),
        F.round("hi", 2).alias("day_high"), F.round("lo", 2).alias("day_low"),
    )


def macro_row(summary: DataFrame, names: list[str]) -> DataFrame:
    """One row with the value of each named series."""
    return summary.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names],
                       F.max(F.when(F.col("name") == "USDCNY", F.col("chg_5d"))).alias("USDCNY_chg_5d"))


def macro_bias() -> dict[str, Column]:
    dxy, vix, us10 = F.coalesce("DXY", F.lit(100.0)), F.coalesce("VIX", F.lit(18.0)), F.coalesce("US10Y", F.lit(0.0))
    signals = present(
        [
            F.when(dxy > 101, L.USD_STRONG).when(dxy < 98, L.USD_WEAK),
            F.when(vix > 25, L.PANIC).when(vix < 18, L.CALM),
            F.when(us10 > 4.5, L.HIGH_RATE),
        ]
    )
    strong = F.contains(F.array_join(signals, ","), F.lit("强"))
    return {
        "signals": signals,
        "bias": F.when(F.size(signals) == 0, L.NEUTRAL).when(strong, L.SHORT).otherwise(L.LONG),
    }


def curve_and_risk() -> dict[str, Column]:
    spread = F.col("US10Y") - F.col("US3M")
    vix = F.lit(L.VIX_LOW)
    for limit, word in reversed(L.VIX_CLASSES):
        vix = F.when(F.col("VIX") > limit, word).otherwise(vix)
    return {
        "spread_10y_3m": spread,
        "curve": F.when(spread < 0, L.INVERTED).otherwise(L.NORMAL),
        "vix_class": vix,
        "dxy_class": F.when(F.col("DXY") > 101, "强势").when(F.col("DXY") < 98, "弱势").otherwise(L.NEUTRAL),
        "fx_pressure": F.col("USDCNY_chg_5d") > 0.3,
    }


def spread_class(spread: Column) -> Column:
    return F.when(spread > 2.5, "outflow").when(spread > 2, "wide").otherwise("normal")


def yield_spread(series: DataFrame, left: str, right: str) -> DataFrame:
    """Two yields on each day either one moved, each carried forward from its own last day."""
    pair = series.filter(F.col("name").isin(left, right)).groupBy("day").agg(
        F.max(F.when(F.col("name") == left, F.col("close"))).alias("a"), F.max(F.when(F.col("name") == right, F.col("close"))).alias("b")
    )
    # days are bounded by the calendar, so the carry-forward needs one small window
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    filled = pair.select("day", F.last("a", True).over(w).alias("a"), F.last("b", True).over(w).alias("b"))
    return filled.filter("a IS NOT NULL AND b IS NOT NULL").withColumn("spread", F.col("a") - F.col("b")).withColumn("spread_class", spread_class(F.col("spread")))


# ---- short interest, warrants, callable contracts -------------------------------------------------------------


def short_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Share of returned volume per symbol and day, in percent, numbered."""
    t = T.ticks(spark, sf)
    days = t.groupBy("symbol", "day").agg((F.lit(100.0) * F.sum(F.when(F.col("flag") == "R", F.col("qty")).otherwise(0.0)) / F.sum("qty")).alias("short_ratio"))
    return days.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("day")) - 1)


def short_tier(ratio: Column) -> Column:
    return F.when(ratio < 10, "low").when(ratio <= 20, "mid").otherwise("high")


def short_trend(mean3: Column, mean5: Column) -> Column:
    return F.when(mean3 < mean5, "covering").when(mean3 > mean5, "building").otherwise("flat")


def warrants(spark: SparkSession, sf: str) -> DataFrame:
    return T.load(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("kind"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("strike"),
        F.col("l_extendedprice").alias("turnover"),
        F.col("l_quantity").alias("outstanding"),
    )


def warrant_stats(warrants: DataFrame, spot: DataFrame) -> DataFrame:
    """Nearest call strike above spot, call and put turnover and their ratio; one aggregation per symbol."""
    x = warrants.join(spot, "symbol")
    call, dist = F.col("kind") == "call", (F.col("strike") - F.col("spot")) / F.col("spot") * 100
    near = call & (F.col("strike") >= F.col("spot"))
    return x.groupBy("symbol").agg(
        F.min(F.when(near, dist)).alias("near_call_dist"),
        F.sum(F.when(call, F.col("turnover")).otherwise(0.0)).alias("call_turnover"),
        F.sum(F.when(~call, F.col("turnover")).otherwise(0.0)).alias("put_turnover"),
    ).withColumn("put_call", F.when(F.col("call_turnover") > 0, F.col("put_turnover") / F.col("call_turnover")))


def callable_stats(contracts: DataFrame, spot: DataFrame) -> DataFrame:
    """Recall prices with the most outstanding on either side, their distances and the gap between them."""
    x = contracts.join(spot, "symbol")
    bull = F.col("kind") == "call"
    order = F.struct(F.col("outstanding"), -F.col("strike"))
    a = x.groupBy("symbol").agg(
        F.max_by("strike", F.when(bull & (F.col("strike") < F.col("spot")), order)).alias("bull_recall"),
        F.max_by("strike", F.when(~bull & (F.col("strike") > F.col("spot")), order)).alias("bear_recall"),
        F.first("spot").alias("spot"),
    )
    bd = (F.col("bull_recall") - F.col("spot")) / F.col("spot") * 100
    return a.select(
        "symbol", "bull_recall", "bear_recall", bd.alias("bull_dist"),
        ((F.col("bear_recall") - F.col("bull_recall")) / F.col("spot") * 100).alias("gap_pct"),
        F.when(F.abs(bd) < 3, "danger").when(F.abs(bd) <= 8, "watch").otherwise("safe").alias("bull_class"),
    )


# ---- calendar -------------------------------------------------------------------------------------------------


def upcoming(events: DataFrame, as_of: Column, day: str = "day") -> DataFrame:
    """Events from today on with a day tag."""
    left = F.datediff(F.col(day), as_of)
    tag = F.when(left == 0, "today").when(left == 1, "tomorrow").otherwise(F.concat(left.cast("string"), F.lit("d")))
    return events.withColumn("days", left).filter("days >= 0").withColumn("tag", tag)
