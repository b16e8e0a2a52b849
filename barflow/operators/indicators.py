"""Indicators as window expressions and linear recurrences.

Bounded-frame indicators are plain columns, so several of them share one window pass. Recursive ones take and
return a DataFrame. All of them take an `Axis` and need a numbered series (`idx`, 0-based).
Every value at bar t uses bars up to t only.
"""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.scan import SERIES, Axis, Recur, arranged, gridded, recur, recur_in_order, ungridded

TINY = 1e-10


def bars_so_far() -> Column:
    return F.col("idx") + 1


def full_at(axis: Axis, n: int) -> Column:
    """Whether there are n bars, or the axis takes fewer."""
    return F.lit(True) if axis.partial else bars_so_far() >= n


def prev(axis: Axis, col: str, k: int) -> Column:
    return F.lag(col, k).over(axis.w())


# ---- bounded frames -------------------------------------------------------------------------------------------


def sma(axis: Axis, t: int, col: str = "close") -> Column:
    return F.avg(col).over(axis.back(t))


def rolling_max(axis: Axis, t: int, col: str = "close") -> Column:
    return F.max(col).over(axis.back(t))


def rolling_min(axis: Axis, t: int, col: str = "close") -> Column:
    return F.min(col).over(axis.back(t))


def sigma(axis: Axis, t: int, col: str = "close") -> Column:
    return F.stddev_pop(col).over(axis.back(t))


def bollinger(axis: Axis, n: int = 20) -> dict[str, Column]:
    """Middle, width and bands over a possibly partial window; zero width and zero lower band become 1e-7."""
    mid, sd = sma(axis, n), sigma(axis, n)
    low = mid - 2 * sd
    return {
        "boll_mid": mid,
        "boll_theta": F.when(sd == 0, 1e-7).otherwise(sd),
        "boll_up": mid + 2 * sd,
        "boll_down": F.when(low == 0, 1e-7).otherwise(low),
    }


def bollinger_summary(axis: Axis, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Rounded bands; a series shorter than `n` reports its last price and no bandwidth or position."""
    mid, sd, full = sma(axis, n), sigma(axis, n), bars_so_far() >= n
    close = F.col("close")
    return {
        "bb_upper": F.when(full, F.round(mid + k * sd, 2)).otherwise(close),
        "bb_middle": F.when(full, F.round(mid, 2)).otherwise(close),
        "bb_lower": F.when(full, F.round(mid - k * sd, 2)).otherwise(close),
        "bb_bandwidth": F.when(full, F.round(2 * k * sd / mid * 100, 1)),
        "bb_position": F.when(full & (sd > 0), F.round((close - mid + k * sd) / (2 * k * sd) * 100, 0)),
    }


def percent_b(axis: Axis) -> dict[str, Column]:
    mid, sd, full = sma(axis, 20), sigma(axis, 20), full_at(axis, 20)
    span = 4 * sd
    return {
        "boll_pct_b": F.when(full & (span != 0), (F.col("close") - (mid - 2 * sd)) / span * 100).otherwise(math.nan if axis.partial else 50.0),
        "boll_width": F.when(full, span / F.greatest(mid, F.lit(TINY)) * 100).otherwise(0.0),
    }


def returns(axis: Axis, k: int) -> Column:
    """Percent change over k bars, 0 (on a partial axis null) while there is no such bar."""
    change = (F.col("close") / prev(axis, "close", k) - 1) * 100
    return change if axis.partial else F.coalesce(change, F.lit(0.0))


def range_pct() -> Column:
    return (F.col("high") - F.col("low")) / F.greatest("close", F.lit(TINY)) * 100


def body_ratio() -> Column:
    return F.abs(F.col("close") - F.col("open")) / F.greatest(F.col("high") - F.col("low"), F.lit(TINY))


def ma_distance(axis: Axis, w: int) -> Column:
    dist = (F.col("close") - sma(axis, w)) / F.greatest("close", F.lit(TINY)) * 100
    return F.when(full_at(axis, w), dist).otherwise(0.0)


def ma_spread(axis: Axis) -> Column:
    ma20 = sma(axis, 20)
    spread = (sma(axis, 5) - ma20) / F.greatest(ma20, F.lit(TINY)) * 100
    return F.when(full_at(axis, 20), spread).otherwise(0.0)


def with_moves(df: DataFrame, axis: Axis) -> DataFrame:
    """Close-to-close move, true range and directional moves: the inputs of the range-based indicators."""
    pc, ph, pl = (prev(axis, c, 1) for c in ("close", "high", "low"))
    up, down = F.col("high") - ph, pl - F.col("low")
    there = F.lit(True) if axis.partial else pc.isNotNull()
    return df.withColumns(
        {
            "diff": F.col("close") - pc,
            "ret1": (F.col("close") - pc) / pc * 100,
            "tr": F.when(
                there,
                F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)),
            ),
            "plus_dm": F.when(up > down, F.greatest(up, F.lit(0.0))).otherwise(F.when(there, 0.0)),
            "minus_dm": F.when(down > up, F.greatest(down, F.lit(0.0))).otherwise(F.when(there, 0.0)),
        }
    )


def atr_pct(axis: Axis) -> Column:
    """Mean true range of 14 bars as % of the close; needs `with_moves`."""
    value = F.avg("tr").over(axis.back(14)) / F.greatest("close", F.lit(TINY)) * 100
    return F.when(full_at(axis, 15), value).otherwise(0.0)


def directional_index(axis: Axis, n: int = 14, of_sums: bool = False) -> Column:
    """Single directional index from n-bar sums, not smoothed a second time; 0 before 2n bars.

    The range cancels out. `of_sums` leaves it out, which rounds less, so that an index of just 30 is not above 30."""
    tr, plus, minus = (F.sum(c).over(axis.back(n)) for c in ("tr", "plus_dm", "minus_dm"))
    p, m = (plus, minus) if of_sums else (plus / tr * 100, minus / tr * 100)
    value = F.when((tr == 0) | (p + m <= 0), 0.0).otherwise(F.abs(p - m) / (p + m) * 100)
    return F.when(full_at(axis, 2 * n), value).otherwise(0.0)


def volatility(axis: Axis) -> dict[str, Column]:
    v5, v10, full = sigma(axis, 5, "ret1"), sigma(axis, 10, "ret1"), full_at(axis, 15)
    flat = F.when(v10 == 0, math.nan) if axis.partial else F.lit(1.0)
    return {
        "volatility_5": F.when(full, v5).otherwise(0.0),
        "volatility_10": F.when(full, v10).otherwise(0.0),
        "volatility_ratio": F.when(full, F.when(v10 > 0, v5 / F.greatest(v10, F.lit(TINY))).otherwise(flat)).otherwise(0.0),
    }


def rsi_simple(axis: Axis, n: int = 14, flat: float = 50.0) -> Column:
    """RSI from plain means of n moves; `flat` is returned when nothing was lost. 50 before n+1 bars."""
    gain = F.avg(F.greatest("diff", F.lit(0.0))).over(axis.back(n))
    loss = F.avg(F.greatest(-F.col("diff"), F.lit(0.0))).over(axis.back(n))
    value = F.when(loss > 0, 100 - 100 / (1 + gain / F.greatest(loss, F.lit(TINY)))).otherwise(flat)
    return F.when(full_at(axis, n + 1), value).otherwise(50.0)


def rsi_divergence(axis: Axis) -> Column:
    """RSI minus the share of up moves in the 15 bars that ended 14 bars ago."""
    ups = F.sum(F.when(F.col("diff") > 0, 1).otherwise(0)).over(axis.w().rowsBetween(-28, -14))
    return F.when(full_at(axis, 30), rsi_simple(axis) - ups / 15 * 100).otherwise(0.0)


def volume_features(axis: Axis) -> dict[str, Column]:
    mean, sd, full = F.avg("volume").over(axis.back(20)), F.stddev_pop("volume").over(axis.back(20)), full_at(axis, 20)
    return {
        "volume_zscore": F.when(full & (sd > 0), (F.col("volume") - mean) / F.greatest(sd, F.lit(TINY))).otherwise(0.0),
        "volume_ratio_ma": F.when(full, F.col("volume") / F.greatest(mean, F.lit(TINY))).otherwise(1.0),
    }


def volume_price(axis: Axis) -> dict[str, Column]:
    """Volume against its 5- and 20-bar mean; changes against the 5th and 20th last close (4 and 19 steps)."""
    m5, m20 = F.avg("volume").over(axis.back(5)), F.avg("volume").over(axis.back(20))
    return {
        "vol_ratio": F.when(m5 > 0, F.col("volume") / m5).otherwise(1.0),
        "vol_vs_20": F.when(m20 > 0, F.col("volume") / m20).otherwise(1.0),
        "chg_4b": (F.col("close") / prev(axis, "close", 4) - 1) * 100,
        "chg_19b": (F.col("close") / prev(axis, "close", 19) - 1) * 100,
    }


def momentum(axis: Axis) -> dict[str, Column]:
    r = {k: F.coalesce(F.col("close") / prev(axis, "close", k) - 1, F.lit(0.0)) for k in (20, 60, 120)}
    return {
        "r20": r[20],
        "r60": r[60],
        "r120": r[120],
        "momentum": r[20] * 0.15 + r[60] * 0.35 + r[120] * 0.50,
    }


def uptrend(axis: Axis) -> Column:
    above = F.col("close") > sma(axis, 120)
    gain = F.col("close") / prev(axis, "close", 120) - 1 > 0
    return F.coalesce((bars_so_far() >= 130) & above & gain, F.lit(False))


def year_change(axis: Axis) -> Column:
    return F.coalesce((F.col("close") / prev(axis, "close", 119) - 1) * 100, F.lit(0.0))


def trend_arrow(axis: Axis) -> Column:
    """Arrows of the 5- over 20-bar mean."""
    ma5 = F.when(bars_so_far() >= 5, sma(axis, 5)).otherwise(F.col("close"))
    ma20 = F.when(bars_so_far() >= 20, sma(axis, 20)).otherwise(F.col("close"))
    return F.when(ma5 > ma20, "↑").otherwise("↓")


def quadrant(axis: Axis) -> Column:
    """Price direction × volume direction against the bar before."""
    up = F.col("close") > prev(axis, "close", 1)
    more = F.col("volume") > prev(axis, "volume", 1)
    return (
        F.when(prev(axis, "close", 1).isNull(), None)
        .when(up & more, "up_up")
        .when(up, "up_down")
        .when(more, "down_up")
        .otherwise("down_down")
    )


def accumulation_inputs(axis: Axis) -> dict[str, Column]:
    """20- against 60-bar mean volume and distance to the 60-bar low."""
    low60 = F.min("low").over(axis.back(60))
    return {
        "vol20": F.avg("volume").over(axis.back(20)),
        "vol60": F.avg("volume").over(axis.back(60)),
        "dist_low60": (F.col("close") / low60 - 1) * 100,
    }


def up_down_volume(axis: Axis) -> dict[str, Column]:
    """Mean volume of up and of down bars and the number of surge up-bars among the last 20."""
    v = F.col("volume")
    return {
        "up_vol": F.avg(F.when(F.col("close") > F.col("open"), v)).over(axis.back(20)),
        "down_vol": F.avg(F.when(F.col("close") < F.col("open"), v)).over(axis.back(20)),
    }


def surge_days(axis: Axis, mean: str = "vol20") -> Column:
    """Up bars of the last 20 whose volume exceeds 1.5 times today's 20-bar mean."""
    recent = F.collect_list(F.when(F.col("close") > F.col("open"), F.col("volume"))).over(axis.back(20))
    return F.size(F.filter(recent, lambda x: x > F.col(mean) * 1.5))


def streak(df: DataFrame, axis: Axis, flag: Column, out: str) -> DataFrame:
    """Length of the current run of true flags."""
    last_false = F.max(F.when(~flag, F.col(axis.order))).over(axis.upto())
    return df.withColumn(out, F.when(flag, F.col(axis.order) - F.coalesce(last_false, axis.first() - 1)).otherwise(0))


def day_stats(axis_day: Axis, axis: Axis) -> dict[str, Column]:
    """Running statistics of the trading day and the 20-bar mean across days."""
    return {
        "t_open": F.first("open").over(axis_day.upto()),
        "t_hi": F.max("high").over(axis_day.upto()),
        "t_lo": F.min("low").over(axis_day.upto()),
        "atr": F.avg(F.col("high") - F.col("low")).over(axis_day.upto()),
        "v_ratio": F.col("volume") / F.avg("volume").over(axis_day.upto()),
        "ma20": sma(axis, 20),
    }


# ---- recursive ------------------------------------------------------------------------------------------------


def macd(df: DataFrame, axis: Axis = SERIES, fast: int = 12, slow: int = 26, signal: int = 9, prefix: str = "") -> DataFrame:
    """EMAs seeded by the first close; the histogram is doubled."""
    f, s = f"{prefix}ema_fast", f"{prefix}ema_slow"
    close = F.col("close")
    df, ax = gridded(df, axis)
    df = recur(df, ax, [Recur(f, close, 2 / (fast + 1), close), Recur(s, close, 2 / (slow + 1), close)])
    df = df.withColumn(f"{prefix}dif", F.col(f) - F.col(s))
    dif = F.col(f"{prefix}dif")
    df = recur(df, ax, [Recur(f"{prefix}dea", dif, 2 / (signal + 1), F.lit(0.0))])
    return ungridded(df.withColumn(f"{prefix}macd", 2 * (dif - F.col(f"{prefix}dea"))).drop(f, s), axis)


def macd_seeded(df: DataFrame, axis: Axis = SERIES, in_order: bool = False) -> DataFrame:
    """EMAs seeded by the mean of the first window and 0 before it; signal seeded at its own window; % of close.

    `in_order` goes row by row: the slope of the histogram divides by values near zero, which shows last bits."""
    outer, (df, axis) = axis, gridded(df, axis)
    close = F.col("close")
    # read where the first window is full, when all rows so far are that window
    mean = F.avg("close").over(axis.upto())
    df = df.withColumns({"_m12": mean, "_m26": mean})
    step = recur_in_order if in_order else recur
    df = step(
        arranged(df, axis) if in_order else df,
        axis,
        [
            Recur("_e12", close, 2 / 13, F.col("_m12"), at=11),
            Recur("_e26", close, 2 / 27, F.col("_m26"), at=25),
        ],
    )
    df = df.withColumn("_line", F.coalesce("_e12", F.lit(0.0)) - F.coalesce("_e26", F.lit(0.0)))
    df = step(df, axis, [Recur("_sig", F.col("_line"), 2 / 10, F.col("_line"), at=8)])
    df = df.withColumn("_sig", F.coalesce("_sig", F.lit(0.0))).withColumn("_hist", F.col("_line") - F.col("_sig"))
    w = axis.w()
    pl, ps, ph = F.lag("_line", 1).over(w), F.lag("_sig", 1).over(w), F.lag("_hist", 4).over(w)
    ok, scale = full_at(axis, 26), F.greatest("close", F.lit(TINY))
    cross = (
        F.when((pl < ps) & (F.col("_line") > F.col("_sig")), 1.0)
        .when((pl > ps) & (F.col("_line") < F.col("_sig")), -1.0)
        .otherwise(0.0)
    )
    cols = {
        "macd_value": F.col("_line") / scale * 100,
        "macd_signal": F.col("_sig") / scale * 100,
        "macd_hist": F.col("_hist") / scale * 100,
        "macd_cross": cross,
        "macd_hist_slope": (F.col("_hist") - ph) / F.greatest(F.abs(ph), F.lit(TINY)),
    }
    df = df.withColumns({k: F.when(ok, v).otherwise(0.0) for k, v in cols.items()})
    return ungridded(df.drop("_m12", "_m26", "_e12", "_e26", "_line", "_sig", "_hist"), outer)


def macd_summary(df: DataFrame, axis: Axis = SERIES) -> DataFrame:
    """Rounded MACD with a single histogram and a trend word; zeros and no trend before 35 bars."""
    df = macd(df, axis, prefix="_s_")
    ok = bars_so_far() >= 35
    dif, dea = F.col("_s_dif"), F.col("_s_dea")
    return df.withColumns(
        {
            "ms_macd": F.when(ok, F.round(dif, 4)).otherwise(0.0),
            "ms_signal": F.when(ok, F.round(dea, 4)).otherwise(0.0),
            "ms_histogram": F.when(ok, F.round(dif - dea, 4)).otherwise(0.0),
            "ms_trend": F.when(ok, F.when(dif > dea, "bullish").otherwise("bearish")),
        }
    ).drop("_s_dif", "_s_dea", "_s_macd")


def rsi_wilder(df: DataFrame, axis: Axis = SERIES, n: int = 14, out: str = "rsi_w") -> DataFrame:
    """Running means for the first n-1 moves, smoothing by 1/n afterwards."""
    outer, (df, axis) = axis, gridded(df, axis)
    d = F.col("_d")
    up, down = F.when(d > 0, d).when(d <= 0, 0.0), F.when(d < 0, -d).when(d >= 0, 0.0)
    df = df.withColumn("_d", F.col("close") - prev(axis, "close", 1))
    df = df.withColumns({"_u0": F.avg(up).over(axis.back(n)), "_d0": F.avg(down).over(axis.back(n))})
    df = recur(
        df,
        axis,
        [Recur("_u", up, 1 / n, F.col("_u0"), at=n - 1), Recur("_v", down, 1 / n, F.col("_d0"), at=n - 1)],
    )
    u, v = F.coalesce("_u", "_u0"), F.coalesce("_v", "_d0")
    rsi = F.when(v == 0, F.when(u > 0, 100.0).otherwise(0.0)).otherwise(100.0 - 100.0 / (1.0 + u / v))
    df = df.withColumn(out, F.when(F.col("idx") == 0, 50.0).otherwise(rsi))
    return ungridded(df.drop("_d", "_u0", "_d0", "_u", "_v"), outer)


def kdj(df: DataFrame, axis: Axis = SERIES, n: int = 9) -> DataFrame:
    outer, (df, axis) = axis, gridded(df, axis)
    hi, lo = F.max("high").over(axis.back(n)), F.min("low").over(axis.back(n))
    df = df.withColumn("_rsv", F.when(hi != lo, 100 * (F.col("close") - lo) / (hi - lo)).otherwise(0.0))
    start = lambda c: 50.0 * 2 / 3 + F.col(c) / 3
    df = recur(df, axis, [Recur("kdj_k", F.col("_rsv"), 1 / 3, start("_rsv"))])
    df = recur(df, axis, [Recur("kdj_d", F.col("kdj_k"), 1 / 3, start("kdj_k"))])
    return ungridded(df.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d")).drop("_rsv"), outer)


def filter_constants(delta: float, vt: float, p0: float = 1.0) -> tuple[float, float]:
    """(r, c): how much of the past a settled filter keeps, and the weight c of its settled part in q(i) = c + (1 - c) r^(2i).

    The filter's variance goes through p -> delta (p + vt) / (p + vt + delta), the action of the matrix
    ((delta, delta vt), (1, vt + delta)); r is delta over its larger eigenvalue, and the products of the matrix are sums of the
    powers of both. With q, the kept share of step i is r q(i-1) / q(i), so the gains need no recursion.
    """
    root = math.sqrt(vt * vt + 4 * delta * vt)
    large = (2 * delta + vt + root) / 2
    small = delta * delta / large
    return delta / large, (p0 + vt + delta - small) / root


def filtered_price(df: DataFrame, axis: Axis = SERIES, delta: float = 1e-4, vt: float = 1e-3) -> DataFrame:
    """Filtered price, its squared-error volatility (EMA 0.94), bands of two volatilities and a state, for any variances that
    are not negative.

    The price times q(i) follows a recurrence with the constant coefficient r; without state noise (vt = 0) the filter is a
    running mean in which the first price weighs delta, without observation noise (delta = 0) it is the price.
    """
    if delta < 0 or vt < 0:
        raise ValueError("variances cannot be negative")
    i, close = F.col("idx").cast("double"), F.col("close")
    if delta == 0:
        df = df.withColumn("kf_price", close)
    elif vt == 0:
        df = df.withColumn("kf_price", (F.sum(close).over(axis.upto()) + (delta - 1) * F.first("close").over(axis.upto())) / (i + delta))
    else:
        r, c = filter_constants(delta, vt)
        q = lambda n: c + (1 - c) * F.pow(F.lit(r), 2 * n)
        share = q(i) - r * q(i - 1)  # gain times q
        df = recur(df, axis, [Recur("_z", share * close / (1 - r), 1 - r, close)])
        df = df.withColumn("kf_price", F.col("_z") / q(i)).drop("_z")
    err = F.col("close") - F.lag("kf_price", 1).over(axis.w())
    df = df.withColumn("_e2", err * err)
    df = recur(df, axis, [Recur("_v", F.col("_e2"), 0.06, F.lit(0.01))])
    vol = F.sqrt("_v")
    upper, lower = F.col("kf_price") + 2 * vol, F.col("kf_price") - 2 * vol
    state = F.when(F.col("close") < lower, "oversold").when(F.col("close") > upper, "overbought").otherwise("neutral")
    return df.withColumns(
        {
            "kf_vol": vol,
            "kf_ann_vol": vol * F.sqrt(F.lit(252.0)) / F.col("close") * 100,
            "kf_upper": upper,
            "kf_lower": lower,
            "kf_state": F.when(bars_so_far() < 5, "insufficient_data").otherwise(state),
        }
    ).drop("_e2", "_v")


def intraday_signal(axis: Axis, threshold: float = 2.0) -> Column:
    """Amplitude of the last 20 prices gates the filter state."""
    hi, lo = F.max("close").over(axis.back(20)), F.min("close").over(axis.back(20))
    amp = (hi - lo) / F.col("close") * 100
    return (
        F.when((F.col("kf_state") == "insufficient_data") | (amp < threshold), "hold")
        .when((F.col("kf_state") == "oversold") & (amp > 3), "buy_t")
        .when((F.col("kf_state") == "overbought") & (amp > 3), "sell_t")
        .otherwise("hold")
    )


# ---- choosing indicators by name ------------------------------------------------------------------------------

METRICS = {
    "macd": lambda df, axis, **o: macd(df, axis, **o),
    "mean": lambda df, axis, t=5: df.withColumn(f"mean_{t}", sma(axis, t)),
    "max": lambda df, axis, t=20: df.withColumn(f"max_{t}", rolling_max(axis, t)),
    "min": lambda df, axis, t=20: df.withColumn(f"min_{t}", rolling_min(axis, t)),
    "boll": lambda df, axis, n=20: df.withColumns(bollinger(axis, n)),
    "rsi": lambda df, axis, n=14: rsi_wilder(df, axis, n),
    "kdj": lambda df, axis, n=9: kdj(df, axis, n),
    "filter": lambda df, axis, **o: filtered_price(df, axis, **o),
}


def with_metrics(df: DataFrame, wanted: list[tuple[str, dict]], axis: Axis = SERIES) -> DataFrame:
    """Per-bar metrics chosen by configuration: [("macd", {}), ("mean", {"t": 10}), ...]."""
    unknown = {name for name, _ in wanted} - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    return reduce(lambda acc, m: METRICS[m[0]](acc, axis, **m[1]), wanted, df)


def tail(df: DataFrame, axis: Axis, n: int) -> DataFrame:
    """The last n rows of each run."""
    top = F.max(axis.order).over(Window.partitionBy(*axis.keys))
    return df.withColumn("_top", top).filter(F.col(axis.order) > F.col("_top") - n).drop("_top")


#: rows from the last bar back that its frames reach: 60 for the means
REACH = 64


def price_features(df: DataFrame, axis: Axis = SERIES, last: int | None = None) -> DataFrame:
    """The price, mean, MACD, band, volatility, RSI, trend and volume features at every bar, or at the last bar alone where
    only the `last` rows of each run are kept once the recurrences are through: no frame reaches further back than REACH."""
    outer, (df, axis) = axis, gridded(df, axis)
    df = macd_seeded(df, axis)
    df = with_moves(tail(df, axis, last) if last else df, axis)
    df = df.withColumns(
        {
            "price_return_1": returns(axis, 1),
            "price_return_3": returns(axis, 3),
            "price_return_5": returns(axis, 5),
            "price_return_10": returns(axis, 10),
            "price_range": range_pct(),
            "body_ratio": body_ratio(),
            **{f"ma_{w}_dist": ma_distance(axis, w) for w in (5, 10, 20, 60)},
            "ma_cross_5_20": ma_spread(axis),
            **percent_b(axis),
            "atr_norm": atr_pct(axis),
            **volatility(axis),
            "rsi": rsi_simple(axis),
            "rsi_divergence": rsi_divergence(axis),
            "adx": directional_index(axis, of_sums=True),
            **volume_features(axis),
        }
    )
    df = df.withColumn("trend_strength", F.when(F.col("adx") > 25, 1.0).otherwise(0.0))
    return ungridded(df.drop("diff", "ret1", "tr", "plus_dm", "minus_dm"), outer)
