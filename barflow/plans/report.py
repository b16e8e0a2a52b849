"""Report, trade plan and live list: tables put together from the other plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.functions import labels as L
from barflow.functions import rules as R
from barflow.operators import bars as B
from barflow.operators import indicators as ind
from barflow.operators import structure as S
from barflow.operators.scan import SERIES, numbered
from barflow.operators.structure import points as P
from barflow.plans import context as C
from barflow.plans import screen
from barflow.session import cut, cut_in_place
from barflow.sources import tables as T


#: what the report and the plan take from a scan
SCAN = ["symbol", "name", "price", "score", "year_chg", "zs", "zone_low", "signal", "position", "is_buy", "types", "sector_score", "entry", "stop", "tp1", "tp2", "rr"]
#: fixed values: the share of capital by tier, in percent
SHARES = {"first": 20, "second": 10, "defensive": 5}


def _lines(df: DataFrame, section: int, order: list, *cols) -> DataFrame:
    w = Window.orderBy(*order)
    return df.select(F.lit(section).alias("section_no"), F.row_number().over(w).alias("row_no"), F.concat_ws(" | ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]).alias("line"))


def build(spark: SparkSession, sf: str, as_of: Column | None = None) -> DataFrame:
    """(section_no, row_no, line) in the fixed section order; section 1 holds the week from `as_of` on. Every section is a
    short top-k or summary table."""
    as_of = F.lit("2001-07-26").cast("date") if as_of is None else as_of
    heads = spark.createDataFrame([(i + 1, 0, f"## {t}") for i, t in enumerate(L.SECTIONS)], "section_no int, row_no int, line string")
    macro = C.macro_summary(C.macro_series(spark, sf))
    scan = cut(screen.full_scan(spark, sf).select(*SCAN))
    second = cut(screen.second_tops(screen.second_scan(spark, sf)))
    inside = scan.filter(F.col("is_buy") & (F.col("position") == L.INSIDE)).orderBy(F.desc("score"), "symbol").limit(10)
    events = C.upcoming(T.load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), as_of).filter("days <= 7")
    heat = C.sector_heat(T.quotes(T.walk_bars(spark, sf)), T.universe(spark, sf))
    parts = [
        _lines(events, 1, ["day", "o_orderkey"], "tag", "day", "o_orderkey"),
        _lines(macro.filter(F.col("name").isin("US3M", "USDCNY")), 2, ["name"], "name", "value", "chg_5d"),
        _lines(macro.filter(F.col("name").isin("US10Y", "DXY", "VIX")), 3, ["name"], "name", "value", "chg_5d"),
        _lines(C.net_positions(C.seats(spark, sf)), 4, ["variety"], "variety", "net", "net_chg", "direction"),
        _lines(heat, 5, [F.desc("chg"), "sector"], "sector", "chg", "up", "dn"),
        _lines(inside, 6, [F.desc("score"), "symbol"], "symbol", "price", "score", "zs", F.round("entry", 2), F.round("stop", 2), F.round("tp1", 2), F.round("tp2", 2), F.round("rr", 1)),
        _lines(second, 7, ["side", "rn"], "side", "symbol", "price", *[F.when(F.col("side") == "buy", x.cast("string")) for x in (F.col("score"), F.round("year_chg"), F.col("zs"))], "signal"),
        _lines(inside, 8, [F.desc("score"), "symbol"], "symbol", "signal", F.round("entry", 2)),
    ]
    out = heads
    for p in parts:
        out = out.unionByName(p)
    return out


def plan_rows(scan: DataFrame) -> DataFrame:
    """In-zone buys with levels and a main-line rank, the allocation part keyed by tier."""
    x = scan.filter(F.col("is_buy") & F.col("zone_low").isNotNull())
    x = x.withColumn("entry_dist", (F.col("entry") - F.col("price")) / F.col("price") * 100).withColumns(R.main_line())
    x = x.withColumn("actionable", R.actionable())
    return x.select("symbol", "name", "price", "score", "year_chg", "zs", "position", "signal", "entry", "stop", "tp1", "tp2", "rr", "main_line", "tier", "actionable")


def trade_plan(spark: SparkSession, sf: str) -> DataFrame:
    return plan_rows(screen.full_scan(spark, sf)).drop("position", "signal")


def plan_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The four sections of the trade plan in one table: in-zone buys, allocation, second market and macro environment.

    A row fills the columns of its section: (section, row_no, code, name, price, score, year_chg, zs, entry, stop, tp1, tp2, rr) for
    buys; way, share and reason for the allocation, whose priority is row_no; side, signal and advice for the second market;
    measure and value for the environment."""
    rows = cut(plan_rows(screen.full_scan(spark, sf)))
    inside = rows.filter(F.col("position") == L.INSIDE)
    number = lambda *order: F.row_number().over(Window.orderBy(*order))
    buys = inside.select(F.lit(1).alias("section"), number(F.desc("score"), "symbol").alias("row_no"), F.col("symbol").alias("code"), "name", "price", "score", "year_chg", "zs", "entry", "stop", "tp1", "tp2", "rr")
    share = F.create_map(*[F.lit(v) for kv in SHARES.items() for v in kv])[F.col("tier")]
    waits = F.col("price") > F.col("entry")
    chosen = rows.filter("actionable").select(
        F.lit(2).alias("section"), number(F.desc("main_line"), "symbol").alias("row_no"), F.col("symbol").alias("code"), "name", F.when(waits, F.col("entry")).otherwise(F.col("price")).alias("price"),
        F.when(waits, "limit").otherwise("market").alias("way"), share.alias("share"), F.concat_ws("|", "tier", "signal").alias("reason"),
    )
    tops = screen.second_tops(screen.second_scan(spark, sf))
    abroad = tops.select(
        F.lit(3).alias("section"), number("side", "rn").alias("row_no"), F.col("symbol").alias("code"), "price", "side", "signal",
        F.when(F.col("side") == "sell", "avoid").when(F.col("in_zone"), "buy_in_zone").otherwise("wait_for_zone").alias("advice"),
    )
    macro = C.macro_summary(C.macro_series(spark, sf)).select(F.col("name").alias("measure"), F.col("value").cast("double").alias("value"))
    seats = C.net_positions(C.seats(spark, sf)).select(F.concat(F.lit("net_"), F.col("variety")).alias("measure"), F.col("net").cast("double").alias("value"))
    around = macro.unionByName(seats)
    around = around.select(F.lit(4).alias("section"), number("measure").alias("row_no"), "measure", "value")
    out = buys
    for part in (chosen, abroad, around):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def live_buy_list(spark: SparkSession, sf: str, quotes: DataFrame | None = None) -> DataFrame:
    """16 columns of the live list. With quotes, the last close is replaced before anything is computed."""
    bars = T.walk_bars(spark, sf)
    if quotes is not None:
        bars = B.autofix(B.live_close(bars, quotes))
    bars = cut_in_place(bars)
    m = ind.macd(bars)
    s = S.build(bars, S.StructureConfig.from_dict(S.config.SCREEN))
    base = screen.summary(s, P.stroke_points(s, m), bars, zone_pick="latest").filter("is_buy").withColumns(R.trade_levels())
    extra = screen.last_bar(ind.tail(bars, SERIES, 2 * ind.REACH).withColumns({**ind.volume_price(SERIES), "ma60": ind.sma(SERIES, 60), "year_chg": ind.year_change(SERIES), "change_pct": ind.returns(SERIES, 1)}))
    x = base.join(extra.select("symbol", "vol_ratio", "ma60", "year_chg", "change_pct"), "symbol").join(T.universe(spark, sf).select("symbol", "name"), "symbol", "left")
    score = R.second_pass()["screen_score"]
    return x.select(
        "symbol", "name", "price", "change_pct", "signal", F.coalesce(score, F.lit(60)).alias("score"), "year_chg", "zs", "position", "entry", "stop", "tp1", "tp2", "rr", "ma60", "vol_ratio",
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    """Structure, score, trend and change of every product series at the hourly level."""
    b = cut(numbered(T.hour_bars(spark, sf), F.date_trunc("month", "ts")).withColumn("day", F.to_date("ts")))
    last = screen.last_bar(b.withColumns({"trend": ind.trend_arrow(SERIES), "chg_pct": F.round((F.col("close") / ind.prev(SERIES, "close", 4) - 1) * 100, 1)}))
    x = screen.scored(b).select("symbol", "price", F.col("xgb_score").alias("score"), "signal", "position", "zs")
    return x.join(last.select("symbol", "trend", "chg_pct"), "symbol")
