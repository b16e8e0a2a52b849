"""Decision rules as column expressions. Inputs are columns of the row; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barflow.functions import labels as L


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def clamp(x: Column, lo: float = 0, hi: float = 100) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def ladder(x: Column, steps: list[tuple[float, float]], default: float = 0) -> Column:
    """First step whose threshold x reaches, from the top."""
    out = F.when(x >= steps[0][0], steps[0][1])
    for limit, value in steps[1:]:
        out = out.when(x >= limit, value)
    return out.otherwise(default)


def present(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda v: v.isNotNull())


def has_main(types: str | Column, kind: str) -> Column:
    """Whether a comma list of point types holds one of main kind 1, 2 or 3."""
    return F.contains(c(types), F.lit(kind))


# ---- signal, position, levels ---------------------------------------------------------------------------------


def position(price: str | Column, low: str | Column, high: str | Column) -> Column:
    p, lo, hi = c(price), c(low), c(high)
    return (
        F.when(lo.isNull(), L.NOWHERE).when((p >= lo) & (p <= hi), L.INSIDE).when(p > hi, L.ABOVE).otherwise(L.BELOW)
    )


def signal_label(is_buy="is_buy", types="types", pos="position") -> Column:
    t = c(types)
    sell = F.when(has_main(t, "3"), L.SELLS["3"]).when(has_main(t, "2"), L.SELLS["2"]).when(has_main(t, "1"), L.SELLS["1"]).otherwise("Sell")
    buy = (
        F.when(c(pos) == L.INSIDE, L.IN_ZONE_BUY).when(has_main(t, "3"), L.BUYS["3"]).when(has_main(t, "2"), L.BUYS["2"])
        .when(has_main(t, "1"), L.BUYS["1"]).otherwise("Buy")
    )
    return F.when(c(is_buy), buy).when(t != "", sell).otherwise("Hold")


def trade_levels(low="zone_low", high="zone_high", truncate: bool = False) -> dict[str, Column]:
    """Entry, stop, two targets and the reward/risk ratio; whole units only for display."""
    lo, hi = c(low), c(high)
    cut = (lambda x: x.cast("bigint").cast("double")) if truncate else (lambda x: x)
    entry, stop, tp1, tp2 = cut(lo), cut(lo * 0.97), cut(hi), cut(hi * 1.1)
    return {
        "entry": entry,
        "stop": stop,
        "tp1": tp1,
        "tp2": tp2,
        "rr": F.when((entry > stop) & (stop > 0), (tp1 - entry) / (entry - stop)).otherwise(0.0),
    }


def rr_compat(low="zone_low", high="zone_high") -> Column:
    """The other reward/risk form: truncated levels, risk of at least one unit."""
    t = trade_levels(low, high, truncate=True)
    return F.abs(t["tp1"] - t["entry"]) / F.greatest(F.abs(t["entry"] - t["stop"]), F.lit(1.0))


def extended(year_chg="year_chg", is_buy="is_buy", types="types") -> Column:
    """More than doubled in 120 bars and a buy that is not of the third kind."""
    return (c(year_chg) > 100) & c(is_buy) & ~has_main(types, "3")


def penalised(score="score", **cols: str) -> Column:
    return F.when(extended(**cols), F.greatest(F.lit(0), c(score) - 15)).otherwise(c(score))


def blend(score="score", vol_score="vol_score", sector_score="sector_score") -> Column:
    return (c(score) * 0.6 + c(vol_score) * 0.2 + c(sector_score) * 0.2).cast("int")


# ---- scores ---------------------------------------------------------------------------------------------------


def feature_score(buys: Column | None = None, sells: Column | None = None, third: Column | None = None, second: Column | None = None) -> Column:
    """0-100 from the features. Without point columns the point terms stay neutral."""
    no = F.lit(False)
    buys, sells, third, second = (x if x is not None else no for x in (buys, sells, third, second))
    rsi = F.col("rsi")
    s = (
        F.lit(50)
        + F.when(buys & third, 25).when(buys & second, 20).otherwise(0)
        - F.when(sells, 15).otherwise(0)
        + F.when(F.col("zs_breakout_dir") == 0, 15).when(F.col("zs_breakout_dir") > 0, 5).otherwise(0)
        + F.when(F.col("macd_cross") > 0, 5).when(F.col("macd_cross") < 0, -5).otherwise(0)
        + F.when((rsi > 30) & (rsi < 70), 5).when(rsi > 75, -5).otherwise(0)
        + F.when(F.col("adx") > 30, 3).otherwise(0)
        + F.when(F.col("volume_zscore") > 1.5, 5).otherwise(0)
    )
    return clamp(s).cast("int")


def volume_signal(ratio="vol_ratio", chg="chg_4b", n: Column | None = None) -> Column:
    r, g = c(ratio), c(chg)
    out = (
        F.when((r > 1.5) & (g < -3), L.VOL_DOWN).when((r > 1.5) & (g > 3), L.VOL_UP)
        .when((r < 0.5) & (g > 3), L.THIN_UP).when((r < 0.5) & (g < -3), L.THIN_DOWN).otherwise(L.VOL_NORMAL)
    )
    return out if n is None else F.when(n < 20, L.VOL_SHORT).otherwise(out)


def volume_score(signal: str | Column = "vol_signal") -> Column:
    return (
        F.when(c(signal) == L.VOL_UP, 70).when(c(signal) == L.VOL_DOWN, 30).when(c(signal) == L.THIN_UP, 60).otherwise(50)
    )


def indicator_vote(rsi="rsi", trend="ms_trend", bb="bb_position") -> dict[str, Column]:
    r = c(rsi)
    score = (
        F.when((r >= 30) & (r <= 40), 1).when(r < 20, 2).otherwise(0)
        + F.when(c(trend) == "bullish", 1).otherwise(0)
        + F.when(c(bb) < 20, 1).otherwise(0)
    )
    word = F.when(score >= 4, "strong_buy").when(score == 3, "buy").when(score == 2, "neutral").otherwise("weak")
    return {"vote": score, "vote_signal": word}


def second_pass(is_buy="is_buy", types="types", price="price", low="zone_low", high="zone_high") -> dict[str, Column]:
    """Bucket, label and score of the stricter screen: a buy needs a zone at or below the price."""
    p, lo, hi = c(price), c(low), c(high)
    inside, above = (p >= lo) & (p <= hi), p > hi
    buy = c(is_buy) & (inside | above)
    late = F.contains(c(types), F.lit("3a")) | F.contains(c(types), F.lit("3b"))
    bucket = F.when(lo.isNull(), "hold").when(buy, "buy").when(~c(is_buy) & (c(types) != ""), "sell").otherwise("hold")
    score = F.when(inside, 75).otherwise(70) + F.when(late, 5).otherwise(0)
    return {
        "bucket": bucket,
        "screen_label": F.when(bucket == "buy", F.when(inside, "盘整买").otherwise("三买")),
        "screen_score": F.when(bucket == "buy", score),
    }


def confirm(is_buy="is_buy", types="types", pos="position", price="price", zs="zs") -> dict[str, Column]:
    b, t, q, p = c(is_buy), c(types), c(pos), c(price)
    items = present(
        [
            F.when((q == L.INSIDE) & b, L.CONFIRM_INSIDE),
            F.when(has_main(t, "3"), L.CONFIRM_THIRD),
            F.when((q == L.BELOW) & b, L.CONFIRM_BELOW),
            F.when(~b & (t != ""), L.CONFIRM_SELL),
        ]
    )
    zone = last_zone(zs)
    target = F.when(zone.isNotNull(), F.when(b, zone["high"]).otherwise(zone["low"])).otherwise(0.0)
    profit = F.when(zone.isNotNull(), F.when(b, (target - p) / p * 100).otherwise((p - target) / p * 100))
    risk = (
        F.when(q == L.INSIDE, L.RISK_LOW).when((q == L.BELOW) & b, L.RISK_HIGH)
        .when(~b & (q == L.ABOVE), L.RISK_LOW).otherwise(L.RISK_MID)
    )
    return {
        "confirmations": items,
        "direction": F.when(b, "Buy").when(t != "", "Sell").otherwise("Hold"),
        "risk": risk,
        "target": target,
        "profit_pct": profit,
    }


def parse_zone(text: Column) -> Column:
    """`lo~hi` to a struct, null when it does not parse."""
    parts = F.split(text, "~")
    lo, hi = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when((F.size(parts) == 2) & lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("low"), hi.alias("high")))


def first_zone(zs: str | Column = "zs") -> Column:
    return parse_zone(F.element_at(F.split(c(zs), ","), 1))


def last_zone(zs: str | Column = "zs") -> Column:
    return parse_zone(F.element_at(F.split(c(zs), ","), -1))


def query_text(types="types", pos="position") -> Column:
    parts = [F.when(F.contains(c(types), F.lit(k)), text).otherwise("") for k, text in L.QUERY_PARTS]
    where = F.lit("")
    for k, text in L.QUERY_POSITION.items():
        where = F.when(c(pos) == k, text).otherwise(where)
    q = F.concat(*parts, where)
    return F.when(q == "", L.QUERY_DEFAULT).otherwise(q)


def smart_money(is_buy="is_buy", pos="position", zs="zs", price="price") -> dict[str, Column]:
    b, q, z, p = c(is_buy), c(pos), c(zs), c(price)
    zone = first_zone(z)
    centre = (zone["low"] + zone["high"]) / 2
    insights = present(
        [
            F.when(q == L.BELOW, L.SMC_SHIFT).when(q == L.INSIDE, L.SMC_RANGE),
            F.when(z != "", L.SMC_BLOCK),
            F.when(q == L.ABOVE, L.SMC_PREMIUM).when(q == L.BELOW, L.SMC_DISCOUNT),
            F.when(F.size(F.split(z, ",")) >= 2, L.SMC_POOL),
            F.when(F.abs(p - centre) > 0.05 * p, L.SMC_GAP),
        ]
    )
    verdict = F.when(b & (q == L.BELOW), L.SMC_UP).when(~b & (q == L.ABOVE), L.SMC_DOWN).otherwise(L.SMC_NONE)
    return {"insights": insights, "verdict": verdict}


def short_term(
    signal="signal", rsi="rsi", trend="macd_trend", bb="bb_pos", vol_ratio="vol_ratio", turnover="turnover",
    flow="main_flow", sector="sector_strength", news="news_score", price="price",
) -> dict[str, Column]:
    """Six part scores, conflict corrections and the total."""
    s, r, b, v, t = c(signal), c(rsi), c(bb), c(vol_ratio), c(turnover)
    quote = clamp(
        F.lit(5) + F.when((v > 1.5) & (c(price) > 0), 3).when(v < 0.8, -2).otherwise(0)
        + F.when(t > 5, 2).when(t < 1, -1).otherwise(0), 0, 10,
    )
    tech = clamp(
        F.when(F.contains(s, F.lit(L.BUYS["1"])), 15).when(F.contains(s, F.lit(L.BUYS["2"])), 12)
        .when(F.contains(s, F.lit(L.BUYS["3"])), 10).when(F.contains(s, F.lit("Sell")), -10).otherwise(5)
        + F.when((r >= 30) & (r <= 40), 3).when(r < 20, 5).when(r > 80, -4).otherwise(0)
        + F.when(c(trend) == "bullish", 3).otherwise(-2)
        + F.when(b < 20, 2).when(b > 80, -2).otherwise(0), 0, 25,
    )
    money = (
        F.when(c(flow) == "strong_inflow", 28).when(c(flow) == "inflow", 22).when(c(flow) == "neutral", 15)
        .when(c(flow) == "outflow", 8).otherwise(5)
    )
    day = clamp(F.lit(8) + F.when((b < 30) & (r < 40), 4).otherwise(0) - F.when((b > 70) & (r > 60), 3).otherwise(0), 0, 15)
    board, talk = F.least(F.lit(10), c(sector)), F.least(F.lit(10), c(news))
    hot, cold, lone = (money >= 24) & (r > 75), (money <= 8) & (tech >= 18), (board >= 8) & (money <= 8)
    fix = F.when(hot, 5).otherwise(0) + F.when(cold, 3).otherwise(0) + F.when(lone, 2).otherwise(0)
    return {
        "quote_score": quote, "tech_score": tech, "flow_score": money, "day_score": day, "sector_part": board,
        "news_part": talk,
        "total_score": clamp(quote + tech + money + day + board + talk - fix),
        "corrections": present([F.when(hot, L.FIX_HOT), F.when(cold, L.FIX_COLD), F.when(lone, L.FIX_SECTOR)]),
    }


def regime_decision(total="total_score", regime="market_regime") -> Column:
    """Grade, decision and position of the highest threshold the score reaches in its regime."""
    known = F.when(c(regime).isin(list(L.REGIMES)), c(regime)).otherwise(L.DEFAULT_REGIME)
    out = F.lit(None).cast("struct<grade:string,decision:string,position_pct:int>")
    for name, steps in L.REGIMES.items():
        for limit, grade, decision, pct in reversed(steps):
            row = F.struct(F.lit(grade).alias("grade"), F.lit(decision).alias("decision"), F.lit(pct).alias("position_pct"))
            out = F.when((known == name) & (c(total) >= limit), row).otherwise(out)
    return out


# ---- leaders --------------------------------------------------------------------------------------------------


def leader(up_ratio="up_ratio", limit_down="limit_down_count") -> dict[str, Column]:
    """Score parts of the leader rule over pool columns joined with structure, sector and market columns.

    Rank in the sector list is 0-based; a stock that is not listed ranks one past its length.
    """
    v, t, cb, sg = F.col("vol_ratio"), F.col("turnover"), F.col("boards"), F.coalesce("signal", F.lit(""))
    start = F.when(F.col("limit_up"), 15).when(F.col("change_pct") >= 7, 10).otherwise(0) + ladder(v, [(3.0, 15), (2.0, 12), (1.5, 8)])
    strength = ladder(cb, [(3, 15), (2, 12), (1, 8)]) + F.when((t >= 5) & (t <= 20), 10).when((t >= 2) & (t < 5), 6).when(t > 30, 2).otherwise(0)
    ident = (
        F.when(F.coalesce("in_zs", F.lit(False)), 15).when(F.coalesce("has_zs", F.lit(False)), 8).otherwise(0)
        + F.when(F.contains(sg, F.lit(L.BUYS["1"])), 10).when(F.contains(sg, F.lit(L.BUYS["2"])), 8)
        .when(F.contains(sg, F.lit(L.BUYS["3"])), 6).when(F.contains(sg, F.lit("Buy")), 4).otherwise(0)
    )
    leading = F.coalesce("leading", F.array().cast("array<string>"))
    at = F.array_position(leading, F.col("symbol"))
    rank = F.when(at > 0, at - 1).otherwise(F.size(leading) + 1)
    chg = F.col("sector_chg")
    sector = F.when(chg >= 5, 10).when(chg >= 2, 6).when(chg > 0, 3).otherwise(0) + F.when(rank == 0, 10).when(rank <= 3, 5).otherwise(0)
    market = -F.when(c(up_ratio) < 0.3, 10).when(c(up_ratio) < 0.5, 5).otherwise(0) - F.when(c(limit_down) > 20, 5).otherwise(0)
    raw = start + strength + ident + sector + market
    final = raw - F.when(chg.isNull() & F.col("limit_up"), 10).otherwise(0)
    return {
        "raw_score": raw,
        "leader_score": clamp(final),
        "leader_level": F.when(final >= 80, "S").when(final >= 60, "A").otherwise("B"),
    }


def advice_level(score="leader_score", level="leader_level") -> Column:
    s, v = c(score), c(level)
    return F.when((v == "S") & (s >= 80), "S").when((v == "A") | ((v == "S") & (s >= 60)), "A").otherwise("B")


# ---- fundamentals ---------------------------------------------------------------------------------------------


def quality_score() -> Column:
    """0-100 from profitability, growth, valuation, debt and cash flow; missing values take their neutral default."""
    roe, gm, rg = (F.coalesce(x, F.lit(0.0)) for x in ("roe", "gross_margin", "revenue_growth"))
    pe, dr = F.coalesce("pe", F.lit(50.0)), F.coalesce("debt_ratio", F.lit(50.0))
    s = (
        ladder(roe, [(25, 30), (20, 25), (15, 20), (10, 10), (5, 5)])
        + ladder(gm, [(60, 20), (40, 15), (30, 10), (20, 5)])
        + ladder(rg, [(30, 15), (20, 12), (10, 8), (0, 3)])
        + F.when((pe > 0) & (pe <= 10), 15).when(pe <= 15, 12).when(pe <= 20, 8).when(pe <= 30, 4).when(pe > 50, -5).otherwise(0)
        + F.when(dr <= 20, 10).when(dr <= 40, 8).when(dr <= 60, 4).otherwise(0)
        + F.when(F.coalesce("fcf", F.lit(0.0)) > 0, 10).when(F.coalesce("operating_cf", F.lit(0.0)) > 0, 5).otherwise(0)
    )
    return clamp(s).cast("int")


# Defaults of missing fundamentals.
DEFAULTS = {"pe": 999.0, "pb": 999.0, "market_cap": 99999.0}


def factor(name: str) -> Column:
    if name == "cash_to_debt":
        return F.coalesce("cash", F.lit(0.0)) / F.greatest(F.coalesce("debt", F.lit(1.0)), F.lit(1.0))
    return F.coalesce(name, F.lit(DEFAULTS.get(name, 0.0)))


def failed_rules(preset: str, extra: bool = False) -> Column:
    """Names of the rules of a preset that a row fails."""
    rules = L.PRESETS[preset] + (L.TURNAROUND_EXTRA if extra and preset == "困境反转" else [])
    out = []
    for name, op, limit in rules:
        v = factor(name)
        bad = v < limit if op == "<" else v > limit if op == ">" else v <= limit
        out.append(F.when(bad, f"{name}{op}{limit}"))
    return present(out)


def best_preset() -> Column:
    """Every passing preset has the same quality score, so the first passing one in declared order wins."""
    out = F.lit(L.NO_MATCH)
    for name in reversed(list(L.PRESETS)):
        out = F.when(F.size(failed_rules(name)) == 0, name).otherwise(out)
    return out


def business_quality() -> Column:
    """Return on equity above 15 %, gross margin above 40 %, positive free cash flow."""
    return F.when(F.col("roe") > 15, 1).otherwise(0) + F.when(F.col("gross_margin") > 40, 1).otherwise(0) + F.when(F.col("fcf") > 0, 1).otherwise(0)


# ---- documented rules -----------------------------------------------------------------------------------------


def main_line(rr="rr", score="score", dist="entry_dist", sector="sector_score") -> dict[str, Column]:
    """40 % reward/risk (capped at 10), 30 % score, 20 % closeness to the entry, 10 % sector; three tiers."""
    near = clamp(F.lit(100) - F.abs(c(dist)))
    total = clamp(c(rr), 0, 10) * 10 * 0.4 + c(score) * 0.3 + near * 0.2 + c(sector) * 0.1
    return {"main_line": total, "tier": F.when(total >= 55, "first").when(total >= 50, "second").otherwise("defensive")}


def actionable(price="price", entry="entry", pos="position", is_buy="is_buy", types="types") -> Column:
    near = F.abs(c(price) - c(entry)) / c(price) * 100 <= 15
    kind = (c(pos) == L.INSIDE) | ((c(pos) == L.BELOW) & has_main(types, "2"))
    return c(is_buy) & near & kind


def chase_risk(year="year_chg", five="chg_5", signal="signal", score="score", has_zone="has_zone") -> Column:
    sell = F.startswith(c(signal), F.lit("Sell"))
    return (
        F.when(~c(has_zone) & sell, "top_risk").when(sell, "reject").when((c(year) > 80) | (c(five) > 10), "do_not_chase")
        .when((c(signal) == L.BUYS["1"]) & (c(score) < 55), "caution").otherwise("ok")
    )


def auction_class(gap="gap_pct", vol_share="vol_share") -> Column:
    """Opening move × opening volume as a share of the mean daily volume."""
    return (
        F.when((c(gap) > 0.5) & (c(vol_share) > 0.2), "grab").when((c(gap) < -0.5) & (c(vol_share) < 0.05), "ignored")
        .when((F.abs(c(gap)) <= 0.5) & (c(vol_share) > 0.2), "contested").otherwise("normal")
    )


def auction_transition(open_flow="open_flow", day_flow="day_flow", open_gain="open_gain", day_gain="day_gain") -> Column:
    return (
        F.when((c(open_flow) < 0) & (c(day_flow) > 0), "probe_then_buy").when(c(day_gain) > c(open_gain), "pushed_up")
        .when((c(day_gain) > 0) & (c(day_gain) < c(open_gain)), "healthy_digest").otherwise("none")
    )


def session_signals(opening="morning_pct", tail="tail_pct") -> Column:
    o, t = c(opening), c(tail)
    return present(
        [
            F.when(o > 30, "opening_grab").when(o > 20, "opening_active"),
            F.when(t > 25, "tail_surge").when(t > 15, "tail_active"),
        ]
    )


def intraday_action(bias="bias", price="close", lo="t_lo", hi="t_hi", ma="ma20", ratio="v_ratio") -> Column:
    """Add or reduce inside the day. The reduce rules run last and win for a neutral bias."""
    b, p, v = c(bias), c(price), c(ratio)
    add = F.when(b.isin("bull", "neutral"), F.when(p < c(lo) * 1.005, "add_low").when((p < c(ma)) & (v > 1.3), "add_below_mean")
                 .when((b == "bull") & (p > c(hi) * 0.98) & (p < c(hi)) & (v < 0.6), "reduce_thin_high"))
    cut = F.when(b.isin("bear", "neutral"), F.when(p > c(hi) * 0.995, "reduce_high").when(v > 1.5, "reduce_spike"))
    return F.coalesce(cut, add)


def accumulation(v20="vol20", v60="vol60", up="up_vol", down="down_vol", surge="surge", dist="dist_low60") -> dict[str, Column]:
    s = (
        F.when(c(v20) > c(v60) * 1.3, 2).otherwise(0) + F.when(c(up) > c(down) * 1.3, 2).otherwise(0)
        + F.when(c(surge) >= 3, 2).otherwise(0) + F.when(c(dist) < 10, 2).otherwise(0)
    )
    return {"acc_score": s, "acc_class": F.when(s >= 6, "strong").when(s >= 4, "medium").when(s >= 2, "weak").otherwise("none")}


def confidence(n_bars="n_bars", has_sub="has_sub", tail_sure="tail_sure", has_zone="has_zone", has_point="has_point") -> dict[str, Column]:
    flags = present(
        [
            F.when(c(n_bars) < 30, "short_history"), F.when(~c(has_sub), "no_lower_level"),
            F.when(~c(tail_sure), "tail_unconfirmed"),
        ]
    )
    level = (
        F.when(c(n_bars) < 30, "low").when(c(has_zone) & c(has_point) & c(tail_sure) & c(has_sub), "high")
        .when(c(has_zone), "medium").otherwise("low")
    )
    return {"confidence": level, "limits": flags}


def two_levels(daily="is_buy", lower="sub_buy") -> Column:
    d, s = c(daily), c(lower)
    return F.when(d & s, "both").when(d, "daily_only").when(s, "lower_only").otherwise("none")


def fusion(state="st", money="mo", sector="ne", sure="conf", market="market", reentry="reentry") -> dict[str, Column]:
    """Action, size factor, score modifier and size cap from structure, money flow, sector support and confidence.

    A fall back into the zone after a third buy closes the trade whatever the other inputs say, like a sell point."""

    def met(col, want):
        return F.lit(True) if want == "any" else c(col) == want

    action, size = F.lit(None).cast("string"), F.lit(None).cast("double")
    for s, f, g, a, n in reversed(L.FUSION):
        row = met(state, s) & met(money, f) & met(sector, g)
        action, size = F.when(row, a).otherwise(action), F.when(row, n).otherwise(size)
    sell, back = c(state) == "sell", c(reentry)
    m = L.FUSION_MODIFIER
    supported = (c(money) == "positive") & (c(sector) == "resonant") & (c(sure) == "high")
    modifier = F.when(sell, m["confirmed_sell"]).when(back, m["zone_reentry"]).when(c(state) == "buy", F.when(supported, m["confirmed_buy"]).otherwise(m["possible_buy"])).otherwise(m["unclear"])
    cap = F.lit(None).cast("string")
    for level, mood, text in L.SIZE_CAP:  # the last row, a sell, comes before all others
        cap = F.when(sell if level == "sell" else met(sure, level) & met(market, mood), text).otherwise(cap)
    gated = back & ~sell
    return {
        "action": F.when(gated, "observe").otherwise(F.coalesce(action, F.lit("observe"))),
        "size": F.when(gated, 0.0).otherwise(F.coalesce(size, F.lit(0.0))),
        "modifier": modifier,
        "cap": F.when(gated, "none").otherwise(cap),
    }
