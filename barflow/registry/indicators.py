"""IND rows: indicators over the daily walk bars, every bar of every symbol."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.operators import indicators as ind
from barflow.operators.scan import SERIES, Axis
from barflow.registry.core import query, r
from barflow.registry.prelude import BARS, HOURS, recursive, with_bars
from barflow.sources import tables as T

W = "OVER (PARTITION BY symbol ORDER BY idx"


def back(k: int) -> str:
    return f"{W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def lag(col: str, k: int = 1) -> str:
    return f"lag({col}, {k}) {W})"


@query(
    "ind01_sma",
    with_bars(f" SELECT symbol, day, round(avg(close) {back(5)}, 2) AS ma5, round(avg(close) {back(20)}, 2) AS ma20, round(avg(close) {back(60)}, 2) AS ma60 FROM bars"),
)
def sma(spark, sf):
    b = T.walk_bars(spark, sf)
    return b.select("symbol", "day", *[r(ind.sma(SERIES, t), 2, f"ma{t}") for t in (5, 20, 60)])


@query(
    "ind02_channel",
    with_bars(f" SELECT symbol, day, max(close) {back(20)} AS hi20, min(close) {back(20)} AS lo20 FROM bars"),
)
def channel(spark, sf):
    b = T.walk_bars(spark, sf)
    return b.select("symbol", "day", ind.rolling_max(SERIES, 20).alias("hi20"), ind.rolling_min(SERIES, 20).alias("lo20"))


@query(
    "ind03_bollinger",
    with_bars(
        f""", s AS (SELECT symbol, day, avg(close) {back(20)} AS m, stddev_pop(close) {back(20)} AS sd FROM bars)
        SELECT symbol, day, round(m, 2) AS boll_mid, round(CASE WHEN sd = 0 THEN 1e-7 ELSE sd END, 2) AS boll_theta,
               round(m + 2 * sd, 2) AS boll_up, round(m - 2 * sd, 2) AS boll_down FROM s"""
    ),
)
def bollinger(spark, sf):
    b = T.walk_bars(spark, sf).withColumns(ind.bollinger(SERIES))
    return b.select("symbol", "day", *[r(c, 2) for c in ("boll_mid", "boll_theta", "boll_up", "boll_down")])


@query(
    "ind04_bollinger_summary",
    with_bars(
        f""", s AS (SELECT symbol, day, idx, close, avg(close) {back(20)} AS m, stddev_pop(close) {back(20)} AS sd FROM bars)
        SELECT symbol, day, CASE WHEN idx >= 19 THEN round(m + 2 * sd, 2) ELSE close END AS bb_upper,
               CASE WHEN idx >= 19 THEN round(m, 2) ELSE close END AS bb_middle,
               CASE WHEN idx >= 19 THEN round(m - 2 * sd, 2) ELSE close END AS bb_lower,
               CASE WHEN idx >= 19 THEN round(4 * sd / m * 100, 1) END AS bb_bandwidth,
               CASE WHEN idx >= 19 AND sd > 0 THEN round((close - m + 2 * sd) / (4 * sd) * 100, 0) + 0.0 END AS bb_position
        FROM s"""
    ),
)
def bollinger_summary(spark, sf):
    b = T.walk_bars(spark, sf).withColumns(ind.bollinger_summary(SERIES))
    return b.select("symbol", "day", "bb_upper", "bb_middle", "bb_lower", "bb_bandwidth", r("bb_position", 0))


@query(
    "ind05_percent_b",
    with_bars(
        f""", s AS (SELECT symbol, day, idx, close, avg(close) {back(20)} AS m, stddev_pop(close) {back(20)} AS sd FROM bars)
        SELECT symbol, day, CASE WHEN idx >= 19 AND sd <> 0 THEN round((close - (m - 2 * sd)) / (4 * sd) * 100, 4) + 0.0 ELSE 50 END AS boll_pct_b,
               CASE WHEN idx >= 19 THEN round(4 * sd / m * 100, 4) ELSE 0 END AS boll_width FROM s"""
    ),
)
def percent_b(spark, sf):
    b = T.walk_bars(spark, sf).withColumns(ind.percent_b(SERIES))
    return b.select("symbol", "day", r("boll_pct_b", 4), r("boll_width", 4))


MACD_SQL = """, m AS (
  SELECT symbol, day, idx, close, close AS ef, close AS es, 0.0::DOUBLE AS dif, 0.0::DOUBLE AS dea FROM bars WHERE idx = 0
  UNION ALL
  SELECT b.symbol, b.day, b.idx, b.close, (2 * b.close + 11 * m.ef) / 13, (2 * b.close + 25 * m.es) / 27,
         (2 * b.close + 11 * m.ef) / 13 - (2 * b.close + 25 * m.es) / 27,
         (2 * ((2 * b.close + 11 * m.ef) / 13 - (2 * b.close + 25 * m.es) / 27) + 8 * m.dea) / 10
  FROM m JOIN bars b ON b.symbol = m.symbol AND b.idx = m.idx + 1)
"""


@query(
    "ind06_macd",
    recursive(MACD_SQL + " SELECT symbol, day, round(dif, 3) + 0.0 AS dif, round(dea, 3) + 0.0 AS dea, round(2 * (dif - dea), 3) + 0.0 AS macd FROM m"),
)
def macd(spark, sf):
    b = ind.macd(T.walk_bars(spark, sf))
    return b.select("symbol", "day", r("dif", 3), r("dea", 3), r("macd", 3))


@query(
    "ind07_macd_seeded",
    recursive(
        f""", a AS (SELECT *, avg(close) {back(12)} AS m12, avg(close) {back(26)} AS m26 FROM bars),
        e AS (
          SELECT symbol, day, idx, close, 0.0::DOUBLE AS e12, 0.0::DOUBLE AS e26, 0.0::DOUBLE AS line, 0.0::DOUBLE AS sig FROM a WHERE idx = 0
          UNION ALL
          SELECT symbol, day, idx, close, e12, e26, e12 - e26 AS line,
                 CASE WHEN idx < 8 THEN 0 WHEN idx = 8 THEN e12 - e26 ELSE 0.2 * (e12 - e26) + 0.8 * psig END AS sig
          FROM (SELECT a.symbol, a.day, a.idx, a.close, e.sig AS psig,
                       CASE WHEN a.idx < 11 THEN 0 WHEN a.idx = 11 THEN a.m12 ELSE 2.0 / 13 * a.close + 11.0 / 13 * e.e12 END AS e12,
                       CASE WHEN a.idx < 25 THEN 0 WHEN a.idx = 25 THEN a.m26 ELSE 2.0 / 27 * a.close + 25.0 / 27 * e.e26 END AS e26
                FROM e JOIN a ON a.symbol = e.symbol AND a.idx = e.idx + 1)),
        h AS (SELECT *, line - sig AS hist, {lag('line')} AS pl, {lag('sig')} AS ps, {lag('line - sig', 4)} AS ph FROM e)
        SELECT symbol, day, CASE WHEN idx >= 25 THEN round(line / close * 100, 4) + 0.0 ELSE 0 END AS macd_value,
               CASE WHEN idx >= 25 THEN round(sig / close * 100, 4) + 0.0 ELSE 0 END AS macd_signal,
               CASE WHEN idx >= 25 THEN round(hist / close * 100, 4) + 0.0 ELSE 0 END AS macd_hist,
               CASE WHEN idx < 25 THEN 0.0 WHEN pl < ps AND line > sig THEN 1.0 WHEN pl > ps AND line < sig THEN -1.0 ELSE 0.0 END::DOUBLE AS macd_cross,
               CASE WHEN idx >= 25 THEN round((hist - ph) / greatest(abs(ph), 1e-10), 1) + 0.0 ELSE 0 END AS macd_hist_slope
        FROM h"""
    ),
)
def macd_seeded(spark, sf):
    b = ind.macd_seeded(T.walk_bars(spark, sf).select("symbol", "day", "idx", "close"), in_order=True)
    return b.select("symbol", "day", *[r(c, 4) for c in ("macd_value", "macd_signal", "macd_hist")], "macd_cross", r("macd_hist_slope", 1))


@query(
    "ind08_macd_summary",
    recursive(
        MACD_SQL
        + """ SELECT symbol, day, CASE WHEN idx >= 34 THEN round(dif, 3) + 0.0 ELSE 0 END AS ms_macd,
              CASE WHEN idx >= 34 THEN round(dea2, 3) + 0.0 ELSE 0 END AS ms_signal,
              CASE WHEN idx >= 34 THEN CASE WHEN dif > dea2 THEN 'bullish' ELSE 'bearish' END END AS ms_trend
              FROM (SELECT *, dea AS dea2 FROM m)"""
    ),
)
def macd_summary(spark, sf):
    b = ind.macd(T.walk_bars(spark, sf), prefix="x_")
    # rounded to 3 places for comparison; the operator itself rounds to 4
    s = ind.macd_summary(b)
    return s.select(
        "symbol", "day",
        F.when(ind.bars_so_far() >= 35, r("x_dif", 3)).otherwise(0.0).alias("ms_macd"),
        F.when(ind.bars_so_far() >= 35, r("x_dea", 3)).otherwise(0.0).alias("ms_signal"),
        "ms_trend",
    )


@query(
    "ind09_rsi_wilder",
    recursive(
        f""", d AS (SELECT symbol, day, idx, close - {lag('close')} AS diff FROM bars),
        g AS (SELECT *, CASE WHEN diff > 0 THEN diff ELSE 0 END AS u, CASE WHEN diff < 0 THEN -diff ELSE 0 END AS v,
                     sum(CASE WHEN diff > 0 THEN diff ELSE 0 END) {back(14)} AS su, sum(CASE WHEN diff < 0 THEN -diff ELSE 0 END) {back(14)} AS sv FROM d),
        w AS (
          SELECT symbol, day, idx, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn FROM g WHERE idx = 0
          UNION ALL
          SELECT g.symbol, g.day, g.idx, CASE WHEN g.idx < 14 THEN g.su / g.idx ELSE (w.up * 13 + g.u) / 14 END,
                 CASE WHEN g.idx < 14 THEN g.sv / g.idx ELSE (w.dn * 13 + g.v) / 14 END
          FROM w JOIN g ON g.symbol = w.symbol AND g.idx = w.idx + 1)
        SELECT symbol, day, round(CASE WHEN idx = 0 THEN 50 WHEN dn = 0 THEN CASE WHEN up > 0 THEN 100 ELSE 0 END
                                       ELSE 100 - 100 / (1 + up / dn) END, 3) + 0.0 AS rsi_w FROM w"""
    ),
)
def rsi_wilder(spark, sf):
    return ind.rsi_wilder(T.walk_bars(spark, sf)).select("symbol", "day", r("rsi_w", 3))


RSI_SQL = f""", d AS (SELECT symbol, day, idx, close - {lag('close')} AS diff FROM bars),
g AS (SELECT *, avg(CASE WHEN diff > 0 THEN diff ELSE 0 END) {back(14)} AS u, avg(CASE WHEN diff < 0 THEN -diff ELSE 0 END) {back(14)} AS v,
             sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) {W} ROWS BETWEEN 28 PRECEDING AND 14 PRECEDING) AS ups FROM d)
"""


@query(
    "ind10_rsi_simple",
    with_bars(
        RSI_SQL
        + """SELECT symbol, day, CASE WHEN idx < 14 THEN 50 WHEN v > 0 THEN round(100 - 100 / (1 + u / v), 3) ELSE 50 END AS rsi_feature,
             CASE WHEN idx < 14 THEN 50 WHEN v > 0 THEN round(100 - 100 / (1 + u / v), 3) ELSE 100 END AS rsi_summary FROM g"""
    ),
)
def rsi_simple(spark, sf):
    b = ind.with_moves(T.walk_bars(spark, sf), SERIES)
    return b.select("symbol", "day", r(ind.rsi_simple(SERIES), 3, "rsi_feature"), r(ind.rsi_simple(SERIES, flat=100.0), 3, "rsi_summary"))


@query(
    "ind11_rsi_divergence",
    with_bars(
        RSI_SQL
        + """SELECT symbol, day, CASE WHEN idx < 29 THEN 0 ELSE round((CASE WHEN v > 0 THEN 100 - 100 / (1 + u / v) ELSE 50 END) - ups / 15.0 * 100, 3) + 0.0 END AS rsi_divergence FROM g"""
    ),
)
def rsi_divergence(spark, sf):
    b = ind.with_moves(T.walk_bars(spark, sf), SERIES)
    return b.select("symbol", "day", r(ind.rsi_divergence(SERIES), 3, "rsi_divergence"))


@query(
    "ind12_kdj",
    recursive(
        f""", s AS (SELECT symbol, day, idx, CASE WHEN max(high) {back(9)} <> min(low) {back(9)}
                 THEN 100 * (close - min(low) {back(9)}) / (max(high) {back(9)} - min(low) {back(9)}) ELSE 0 END AS rsv FROM bars),
        k AS (
          SELECT symbol, day, idx, (100 + rsv) / 3 AS k, (100 + (100 + rsv) / 3) / 3 AS d FROM s WHERE idx = 0
          UNION ALL
          SELECT s.symbol, s.day, s.idx, (2 * k.k + s.rsv) / 3, (2 * k.d + (2 * k.k + s.rsv) / 3) / 3
          FROM k JOIN s ON s.symbol = k.symbol AND s.idx = k.idx + 1)
        SELECT symbol, day, round(k, 3) + 0.0 AS kdj_k, round(d, 3) + 0.0 AS kdj_d, round(3 * k - 2 * d, 3) + 0.0 AS kdj_j FROM k"""
    ),
)
def kdj(spark, sf):
    return ind.kdj(T.walk_bars(spark, sf)).select("symbol", "day", r("kdj_k", 3), r("kdj_d", 3), r("kdj_j", 3))


MOVES_SQL = f""", p AS (SELECT *, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl FROM bars),
mv AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, (close - pc) / pc * 100 AS ret1,
              CASE WHEN high - ph > pl - low THEN greatest(high - ph, 0) ELSE 0 END AS pdm,
              CASE WHEN pl - low > high - ph THEN greatest(pl - low, 0) ELSE 0 END AS mdm FROM p)
"""


@query(
    "ind15_atr",
    with_bars(MOVES_SQL + f" SELECT symbol, day, CASE WHEN idx >= 14 THEN round(avg(tr) {back(14)} / close * 100, 4) ELSE 0 END AS atr_norm FROM mv"),
)
def atr(spark, sf):
    b = ind.with_moves(T.walk_bars(spark, sf), SERIES)
    return b.select("symbol", "day", r(ind.atr_pct(SERIES), 4, "atr_norm"))


@query(
    "ind16_directional_index",
    with_bars(
        MOVES_SQL
        + f""", t AS (SELECT symbol, day, idx, sum(tr) {back(14)} AS tr, sum(pdm) {back(14)} AS p, sum(mdm) {back(14)} AS m FROM mv)
        SELECT symbol, day, CASE WHEN idx < 27 OR tr = 0 OR p + m <= 0 THEN 0
               ELSE round(abs(p / tr * 100 - m / tr * 100) / (p / tr * 100 + m / tr * 100) * 100, 4) + 0.0 END AS adx FROM t"""
    ),
)
def directional_index(spark, sf):
    b = ind.with_moves(T.walk_bars(spark, sf), SERIES)
    return b.select("symbol", "day", r(ind.directional_index(SERIES), 4, "adx"))


@query(
    "ind17_volatility",
    with_bars(
        MOVES_SQL
        + f""", v AS (SELECT symbol, day, idx, stddev_pop(ret1) {back(5)} AS v5, stddev_pop(ret1) {back(10)} AS v10 FROM mv)
        SELECT symbol, day, CASE WHEN idx >= 14 THEN round(v5, 4) ELSE 0 END AS volatility_5,
               CASE WHEN idx >= 14 THEN round(v10, 4) ELSE 0 END AS volatility_10,
               CASE WHEN idx < 14 THEN 0 WHEN v10 > 0 THEN round(v5 / greatest(v10, 1e-10), 4) ELSE 1 END AS volatility_ratio FROM v"""
    ),
)
def volatility(spark, sf):
    b = ind.with_moves(T.walk_bars(spark, sf), SERIES).withColumns(ind.volatility(SERIES))
    return b.select("symbol", "day", *[r(c, 4) for c in ("volatility_5", "volatility_10", "volatility_ratio")])


@query(
    "ind18_returns",
    with_bars(
        " SELECT symbol, day, "
        + ", ".join(f"round(coalesce((close / {lag('close', k)} - 1) * 100, 0), 4) + 0.0 AS price_return_{k}" for k in (1, 3, 5, 10))
        + " FROM bars"
    ),
)
def returns(spark, sf):
    b = T.walk_bars(spark, sf)
    return b.select("symbol", "day", *[r(ind.returns(SERIES, k), 4, f"price_return_{k}") for k in (1, 3, 5, 10)])


@query(
    "ind19_range_body",
    with_bars(" SELECT symbol, day, round((high - low) / close * 100, 4) AS price_range, round(abs(close - open) / greatest(high - low, 1e-10), 4) AS body_ratio FROM bars"),
)
def range_body(spark, sf):
    return T.walk_bars(spark, sf).select("symbol", "day", r(ind.range_pct(), 4, "price_range"), r(ind.body_ratio(), 4, "body_ratio"))


@query(
    "ind20_ma_distance",
    with_bars(
        " SELECT symbol, day, "
        + ", ".join(f"CASE WHEN idx >= {w - 1} THEN round((close - avg(close) {back(w)}) / close * 100, 4) + 0.0 ELSE 0 END AS ma_{w}_dist" for w in (5, 10, 20, 60))
        + f", CASE WHEN idx >= 19 THEN round((avg(close) {back(5)} - avg(close) {back(20)}) / avg(close) {back(20)} * 100, 4) + 0.0 ELSE 0 END AS ma_cross_5_20 FROM bars"
    ),
)
def ma_distance(spark, sf):
    b = T.walk_bars(spark, sf)
    return b.select("symbol", "day", *[r(ind.ma_distance(SERIES, w), 4, f"ma_{w}_dist") for w in (5, 10, 20, 60)], r(ind.ma_spread(SERIES), 4, "ma_cross_5_20"))


@query(
    "ind21_volume_zscore",
    with_bars(
        f""", v AS (SELECT symbol, day, idx, volume, avg(volume) {back(20)} AS m, stddev_pop(volume) {back(20)} AS sd FROM bars)
        SELECT symbol, day, CASE WHEN idx >= 19 AND sd > 0 THEN round((volume - m) / sd, 4) + 0.0 ELSE 0 END AS volume_zscore,
               CASE WHEN idx >= 19 THEN round(volume / m, 4) ELSE 1 END AS volume_ratio_ma FROM v"""
    ),
)
def volume_zscore(spark, sf):
    b = T.walk_bars(spark, sf).withColumns(ind.volume_features(SERIES))
    return b.select("symbol", "day", r("volume_zscore", 4), r("volume_ratio_ma", 4))


@query(
    "ind22_volume_ratio",
    with_bars(
        f""" SELECT symbol, day, round(volume / avg(volume) {back(5)}, 4) AS vol_ratio, round(volume / avg(volume) {back(20)}, 4) AS vol_vs_20,
             round((close / {lag('close', 4)} - 1) * 100, 4) + 0.0 AS chg_4b, round((close / {lag('close', 19)} - 1) * 100, 4) + 0.0 AS chg_19b FROM bars"""
    ),
)
def volume_ratio(spark, sf):
    b = T.walk_bars(spark, sf).withColumns(ind.volume_price(SERIES))
    return b.select("symbol", "day", *[r(c, 4) for c in ("vol_ratio", "vol_vs_20", "chg_4b", "chg_19b")])


MOMENTUM_SQL = f""", mo AS (SELECT *, coalesce(close / {lag('close', 20)} - 1, 0) AS r20, coalesce(close / {lag('close', 60)} - 1, 0) AS r60,
       coalesce(close / {lag('close', 120)} - 1, 0) AS r120, avg(close) {back(120)} AS ma120 FROM bars)
"""


@query(
    "ind23_momentum",
    with_bars(MOMENTUM_SQL + " SELECT symbol, day, round(r20 * 0.15 + r60 * 0.35 + r120 * 0.5, 6) + 0.0 AS momentum FROM mo"),
)
def momentum(spark, sf):
    return T.walk_bars(spark, sf).select("symbol", "day", r(ind.momentum(SERIES)["momentum"], 6, "momentum"))


@query(
    "ind24_trend_gate",
    with_bars(MOMENTUM_SQL + " SELECT symbol, day, idx >= 129 AND close > ma120 AND r120 > 0 AS in_uptrend FROM mo"),
)
def trend_gate(spark, sf):
    return T.walk_bars(spark, sf).select("symbol", "day", ind.uptrend(SERIES).alias("in_uptrend"))


@query(
    "ind25_year_change",
    with_bars(f" SELECT symbol, day, round(coalesce((close / {lag('close', 119)} - 1) * 100, 0), 4) + 0.0 AS year_chg FROM bars"),
)
def year_change(spark, sf):
    return T.walk_bars(spark, sf).select("symbol", "day", r(ind.year_change(SERIES), 4, "year_chg"))


KALMAN_SQL = """, kf AS (
  SELECT symbol, day, idx, close, close AS x, 1.0::DOUBLE AS p, 0.01::DOUBLE AS v FROM bars WHERE idx = 0
  UNION ALL
  SELECT b.symbol, b.day, b.idx, b.close, kf.x + (kf.p + 1e-3) / (kf.p + 1e-3 + 1e-4) * (b.close - kf.x),
         (1 - (kf.p + 1e-3) / (kf.p + 1e-3 + 1e-4)) * (kf.p + 1e-3), 0.94 * kf.v + 0.06 * pow(b.close - kf.x, 2)
  FROM kf JOIN bars b ON b.symbol = kf.symbol AND b.idx = kf.idx + 1),
ks AS (SELECT *, CASE WHEN idx < 4 THEN 'insufficient_data' WHEN close < x - 2 * sqrt(v) THEN 'oversold'
              WHEN close > x + 2 * sqrt(v) THEN 'overbought' ELSE 'neutral' END AS kf_state FROM kf)
"""


@query(
    "ind26_filtered_price",
    recursive(
        KALMAN_SQL
        + """ SELECT symbol, day, round(x, 2) AS kf_price, round(sqrt(v), 2) AS kf_vol, round(sqrt(v) * sqrt(252) / close * 100, 3) AS kf_ann_vol,
              round(x + 2 * sqrt(v), 2) AS kf_upper, round(x - 2 * sqrt(v), 2) AS kf_lower, kf_state FROM ks"""
    ),
)
def filtered_price(spark, sf):
    b = ind.filtered_price(T.walk_bars(spark, sf))
    return b.select("symbol", "day", r("kf_price", 2), r("kf_vol", 2), r("kf_ann_vol", 3), r("kf_upper", 2), r("kf_lower", 2), "kf_state")


def _kalman(delta: str, vt: str) -> str:
    return KALMAN_SQL.replace("1e-4", delta).replace("1e-3", vt)


@query("ind26_fast_filter", recursive(_kalman("1e-8", "1e-3") + " SELECT symbol, day, round(x, 2) AS kf_price, round(sqrt(v), 2) AS kf_vol FROM ks"))
def fast_filter(spark, sf):
    b = ind.filtered_price(T.walk_bars(spark, sf), delta=1e-8)
    return b.select("symbol", "day", r("kf_price", 2), r("kf_vol", 2))


@query("ind26_slow_filter", recursive(_kalman("1000.0", "1e-6") + " SELECT symbol, day, round(x, 2) AS kf_price, round(sqrt(v), 2) AS kf_vol FROM ks"))
def slow_filter(spark, sf):
    b = ind.filtered_price(T.walk_bars(spark, sf), delta=1000.0, vt=1e-6)
    return b.select("symbol", "day", r("kf_price", 2), r("kf_vol", 2))


@query(
    "ind27_intraday_signal",
    recursive(
        KALMAN_SQL
        + f""", am AS (SELECT *, (max(close) {back(20)} - min(close) {back(20)}) / close * 100 AS amp FROM ks)
        SELECT symbol, day, CASE WHEN kf_state = 'insufficient_data' OR amp < 0.5 THEN 'hold' WHEN kf_state = 'oversold' AND amp > 3 THEN 'buy_t'
               WHEN kf_state = 'overbought' AND amp > 3 THEN 'sell_t' ELSE 'hold' END AS t_signal FROM am"""
    ),
)
def intraday_signal(spark, sf):
    b = ind.filtered_price(T.walk_bars(spark, sf))
    return b.select("symbol", "day", ind.intraday_signal(SERIES, threshold=0.5).alias("t_signal"))


HN = HOURS + ", hb AS (SELECT *, ts::DATE AS day, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::INTEGER AS idx FROM hbars)"
DW = "OVER (PARTITION BY symbol, day ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DAY_AXIS = Axis(keys=("symbol", "day"))


def hour_series(spark, sf):
    from barflow.operators.scan import numbered

    b = numbered(T.hour_bars(spark, sf), F.date_trunc("month", "ts"))
    return b.withColumn("day", F.to_date("ts"))


@query(
    "ind28_day_stats",
    "WITH " + HN + f""" SELECT symbol, ts, round(first(open) {DW}, 4) AS t_open, max(high) {DW} AS t_hi, min(low) {DW} AS t_lo, round(avg(high - low) {DW}, 6) AS atr,
      round(volume / avg(volume) {DW}, 6) AS v_ratio, round(avg(close) {back(20)}, 6) AS ma20 FROM hb""",
)
def day_stats(spark, sf):
    b = hour_series(spark, sf).withColumns(ind.day_stats(DAY_AXIS, SERIES))
    return b.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), r("t_open", 4), "t_hi", "t_lo", r("atr", 6), r("v_ratio", 6), r("ma20", 6))


@query(
    "ind30_trend_arrow",
    with_bars(
        f""" SELECT symbol, day, CASE WHEN (CASE WHEN idx >= 4 THEN round(avg(close) {back(5)}, 6) ELSE close END) > (CASE WHEN idx >= 19 THEN round(avg(close) {back(20)}, 6) ELSE close END)
             THEN '↑' ELSE '↓' END AS trend, round((close / {lag('close', 4)} - 1) * 100, 1) + 0.0 AS chg_pct FROM bars"""
    ),
)
def trend_arrow(spark, sf):
    b = T.walk_bars(spark, sf)
    return b.select("symbol", "day", ind.trend_arrow(SERIES).alias("trend"), r((F.col("close") / ind.prev(SERIES, "close", 4) - 1) * 100, 1, "chg_pct"))


SHORT_SQL = """, sh AS (SELECT symbol, day, 100.0 * sum(CASE WHEN flag = 'R' THEN qty ELSE 0 END) / sum(qty) AS ratio FROM ticks GROUP BY 1, 2),
si AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS idx FROM sh)
"""


@query(
    "ind31_short_ratio",
    with_bars(
        SHORT_SQL
        + f""" SELECT symbol, day, round(ratio, 4) AS short_ratio, round(avg(ratio) {back(3)}, 4) AS mean3, round(avg(ratio) {back(5)}, 4) AS mean5,
        CASE WHEN ratio < 10 THEN 'low' WHEN ratio <= 20 THEN 'mid' ELSE 'high' END AS tier FROM si"""
    ),
)
def short_ratio(spark, sf):
    from barflow.plans import context

    s = context.short_ratios(spark, sf)
    return s.select(
        "symbol", "day", r("short_ratio", 4), r(F.avg("short_ratio").over(SERIES.back(3)), 4, "mean3"),
        r(F.avg("short_ratio").over(SERIES.back(5)), 4, "mean5"), context.short_tier(F.col("short_ratio")).alias("tier"),
    )


@query(
    "ind32_streak",
    with_bars(
        f""", u AS (SELECT symbol, day, idx, coalesce((close / {lag('close')} - 1) * 100 > 0.2, false) AS up FROM bars),
        g AS (SELECT *, coalesce(max(CASE WHEN NOT up THEN idx END) {W} ROWS UNBOUNDED PRECEDING), -1) AS lf FROM u)
        SELECT symbol, day, CASE WHEN up THEN idx - lf ELSE 0 END::INTEGER AS boards FROM g"""
    ),
)
def streak(spark, sf):
    b = T.walk_bars(spark, sf).withColumn("up", ind.returns(SERIES, 1) > 0.2)
    return ind.streak(b, SERIES, F.col("up"), "boards").select("symbol", "day", F.col("boards").cast("int").alias("boards"))


@query(
    "ind33_accumulation_inputs",
    with_bars(f" SELECT symbol, day, round(avg(volume) {back(20)}, 3) AS vol20, round(avg(volume) {back(60)}, 3) AS vol60, round((close / min(low) {back(60)} - 1) * 100, 4) AS dist_low60 FROM bars"),
)
def accumulation_inputs(spark, sf):
    b = T.walk_bars(spark, sf).withColumns(ind.accumulation_inputs(SERIES))
    return b.select("symbol", "day", r("vol20", 3), r("vol60", 3), r("dist_low60", 4))


@query(
    "ind34_price_volume_quadrant",
    with_bars(
        f""", q AS (SELECT *, {lag('close')} AS pc, {lag('volume')} AS pv FROM bars)
        SELECT symbol, day, CASE WHEN pc IS NULL THEN NULL WHEN close > pc AND volume > pv THEN 'up_up' WHEN close > pc THEN 'up_down'
               WHEN volume > pv THEN 'down_up' ELSE 'down_down' END AS quadrant FROM q"""
    ),
)
def quadrant(spark, sf):
    return T.walk_bars(spark, sf).select("symbol", "day", ind.quadrant(SERIES).alias("quadrant"))


@query("ind_blocked_axis", None)
def blocked_axis(spark, sf):
    """The same MACD computed on blocks with a halo: the form for fine levels with very long series."""
    from barflow.operators.scan import blocked, settle

    cut, axis = blocked(T.walk_bars(spark, sf), rows=200, halo=700)
    return settle(ind.macd(cut, axis)).select("symbol", "day", r("macd", 3))
