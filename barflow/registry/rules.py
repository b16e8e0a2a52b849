"""RULE rows. Rules that take finished signals read them from a table derived from the customers, one row each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barflow.functions import labels as L
from barflow.functions import rules as R
from barflow.operators import indicators as ind
from barflow.operators.scan import SERIES
from barflow.plans import context as C
from barflow.plans import screen
from barflow.registry import shared
from barflow.registry.core import query, r
from barflow.registry.indicators import MACD_SQL, back, lag
from barflow.registry.prelude import FUNDAMENTALS, QUOTES, UNIVERSE, recursive, with_bars
from barflow.session import cut
from barflow.sources import tables as T

TYPES = ["", "1", "1p", "2", "2s", "3a", "3b", "2,3b"]
PLACES = [L.INSIDE, L.ABOVE, L.BELOW, L.NOWHERE]
FLOWS = ["strong_inflow", "inflow", "neutral", "outflow", "strong_outflow"]
REGIMES = [*L.REGIMES, "?"]


def lit(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SIG = f"""
sig0 AS (
  SELECT c_custkey AS code, c_custkey AS k, c_custkey % 2 = 0 AS is_buy, {lit(TYPES)}[(1 + c_custkey // 2 % 8)::INTEGER] AS types,
         {lit(PLACES)}[(1 + c_custkey // 3 % 4)::INTEGER] AS position, (70 + c_custkey * 7 % 80)::DOUBLE AS price,
         80 + c_custkey % 40 AS lo, 85 + c_custkey % 40 + c_custkey % 11 AS hi, c_custkey * 13 % 101 AS score FROM customer),
sig AS (
  SELECT *, CASE WHEN position <> '{L.NOWHERE}' THEN lo::DOUBLE END AS zone_low, CASE WHEN position <> '{L.NOWHERE}' THEN hi::DOUBLE END AS zone_high,
         CASE WHEN position = '{L.NOWHERE}' THEN '' WHEN k % 5 = 0 THEN lo || '~' || hi || ',' || (lo + 20) || '~' || (hi + 20) ELSE lo || '~' || hi END AS zs FROM sig0)
"""


def S(body: str) -> str:
    return "WITH " + SIG + body


def pick(values, i):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def signals(spark, sf):
    k = F.col("c_custkey")
    third = lambda n: F.floor(k / n)
    x = T.load(spark, sf, "customer").select(
        k.alias("code"), k.alias("k"), (k % 2 == 0).alias("is_buy"), pick(TYPES, third(2) % 8).alias("types"), pick(PLACES, third(3) % 4).alias("position"),
        (70 + k * 7 % 80).cast("double").alias("price"), (80 + k % 40).alias("lo"), (85 + k % 40 + k % 11).alias("hi"), (k * 13 % 101).alias("score"),
    )
    there = F.col("position") != L.NOWHERE
    pair = lambda d: F.concat((F.col("lo") + d).cast("string"), F.lit("~"), (F.col("hi") + d).cast("string"))
    return x.withColumns(
        {
            "zone_low": F.when(there, F.col("lo").cast("double")),
            "zone_high": F.when(there, F.col("hi").cast("double")),
            "zs": F.when(~there, "").when(F.col("k") % 5 == 0, F.concat(pair(0), F.lit(","), pair(20))).otherwise(pair(0)),
        }
    )


LABEL_SQL = (
    f"CASE WHEN is_buy THEN CASE WHEN position = '{L.INSIDE}' THEN '{L.IN_ZONE_BUY}' WHEN types LIKE '%3%' THEN '{L.BUYS['3']}' WHEN types LIKE '%2%' THEN '{L.BUYS['2']}' WHEN types LIKE '%1%' THEN '{L.BUYS['1']}' ELSE 'Buy' END "
    f"WHEN types <> '' THEN CASE WHEN types LIKE '%3%' THEN '{L.SELLS['3']}' WHEN types LIKE '%2%' THEN '{L.SELLS['2']}' WHEN types LIKE '%1%' THEN '{L.SELLS['1']}' ELSE 'Sell' END ELSE 'Hold' END"
)


@query("str38_signal_label", S(f" SELECT code, {LABEL_SQL} AS signal FROM sig"))
def signal_label(spark, sf):
    return signals(spark, sf).select("code", R.signal_label().alias("signal"))


@query("prj10_parse_zones", S(" SELECT code, CASE WHEN zs <> '' THEN split_part(split_part(zs, ',', 1), '~', 1)::DOUBLE END AS first_low, CASE WHEN zs <> '' THEN split_part(split_part(zs, ',', -1), '~', 2)::DOUBLE END AS last_high FROM sig"))
def parse_zones(spark, sf):
    return signals(spark, sf).select("code", R.first_zone()["low"].alias("first_low"), R.last_zone()["high"].alias("last_high"))


FEATURES = [
    "price_return_1", "price_return_3", "price_return_5", "price_return_10", "price_range", "body_ratio", "ma_5_dist", "ma_10_dist", "ma_20_dist", "ma_60_dist", "ma_cross_5_20",
    "boll_pct_b", "boll_width", "atr_norm", "volatility_5", "volatility_10", "volatility_ratio", "rsi", "rsi_divergence", "adx", "trend_strength", "volume_zscore", "volume_ratio_ma",
    "macd_value", "macd_signal", "macd_hist", "macd_cross",
]

FEATURE_SQL = f""", fa AS (SELECT *, avg(close) {back(12)} AS m12, avg(close) {back(26)} AS m26, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl FROM bars),
fe AS (
  SELECT symbol, idx, close, 0.0::DOUBLE AS e12, 0.0::DOUBLE AS e26, 0.0::DOUBLE AS line, 0.0::DOUBLE AS sig FROM fa WHERE idx = 0
  UNION ALL
  SELECT symbol, idx, close, e12, e26, e12 - e26, CASE WHEN idx < 8 THEN 0 WHEN idx = 8 THEN e12 - e26 ELSE 0.2 * (e12 - e26) + 0.8 * psig END
  FROM (SELECT a.symbol, a.idx, a.close, e.sig AS psig, CASE WHEN a.idx < 11 THEN 0 WHEN a.idx = 11 THEN a.m12 ELSE 2.0 / 13 * a.close + 11.0 / 13 * e.e12 END AS e12,
               CASE WHEN a.idx < 25 THEN 0 WHEN a.idx = 25 THEN a.m26 ELSE 2.0 / 27 * a.close + 25.0 / 27 * e.e26 END AS e26 FROM fe e JOIN fa a ON a.symbol = e.symbol AND a.idx = e.idx + 1)),
fm AS (SELECT *, {lag('line')} AS pline, {lag('sig')} AS psig FROM fe),
fb AS (
  SELECT a.*, m.line, m.sig, m.pline, m.psig, a.close - a.pc AS diff, (a.close - a.pc) / a.pc * 100 AS ret1, greatest(a.high - a.low, abs(a.high - a.pc), abs(a.low - a.pc)) AS tr,
         CASE WHEN a.high - a.ph > a.pl - a.low THEN greatest(a.high - a.ph, 0) ELSE 0 END AS pdm, CASE WHEN a.pl - a.low > a.high - a.ph THEN greatest(a.pl - a.low, 0) ELSE 0 END AS mdm
  FROM fa a JOIN fm m ON m.symbol = a.symbol AND m.idx = a.idx),
fc AS (
  SELECT symbol, day, idx, close, volume, high, low, open, line, sig, pline, psig,
         close / {lag('close', 1)} - 1 AS q1, close / {lag('close', 3)} - 1 AS q3, close / {lag('close', 5)} - 1 AS q5, close / {lag('close', 10)} - 1 AS q10,
         avg(close) {back(5)} AS m5, avg(close) {back(10)} AS m10, avg(close) {back(20)} AS m20, avg(close) {back(60)} AS m60, stddev_pop(close) {back(20)} AS sd20,
         avg(tr) {back(14)} AS atr, stddev_pop(ret1) {back(5)} AS v5, stddev_pop(ret1) {back(10)} AS v10,
         avg(greatest(diff, 0)) {back(14)} AS gain, avg(greatest(-diff, 0)) {back(14)} AS loss, sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 28 PRECEDING AND 14 PRECEDING) AS ups,
         sum(tr) {back(14)} AS str, sum(pdm) {back(14)} AS sp, sum(mdm) {back(14)} AS sm, avg(volume) {back(20)} AS vm, stddev_pop(volume) {back(20)} AS vsd,
         avg(volume) {back(5)} AS vm5, {lag('close', 4)} AS c4, {lag('close', 119)} AS c119, max(idx) OVER (PARTITION BY symbol) AS n
  FROM fb),
feats AS (
  SELECT symbol, day, idx, close, q1 * 100 AS price_return_1, q3 * 100 AS price_return_3, q5 * 100 AS price_return_5, q10 * 100 AS price_return_10,
         (high - low) / close * 100 AS price_range, abs(close - open) / greatest(high - low, 1e-10) AS body_ratio, (close - m5) / close * 100 AS ma_5_dist, (close - m10) / close * 100 AS ma_10_dist,
         (close - m20) / close * 100 AS ma_20_dist, (close - m60) / close * 100 AS ma_60_dist, (m5 - m20) / m20 * 100 AS ma_cross_5_20,
         (close - (m20 - 2 * sd20)) / (4 * sd20) * 100 AS boll_pct_b, 4 * sd20 / m20 * 100 AS boll_width, atr / close * 100 AS atr_norm, v5 AS volatility_5, v10 AS volatility_10, v5 / v10 AS volatility_ratio,
         CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) ELSE 50 END AS rsi, (CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) ELSE 50 END) - ups / 15.0 * 100 AS rsi_divergence,
         CASE WHEN str = 0 OR sp + sm <= 0 THEN 0 ELSE abs(sp - sm) / (sp + sm) * 100 END AS adx, CASE WHEN str > 0 AND sp + sm > 0 AND abs(sp - sm) / (sp + sm) * 100 > 25 THEN 1.0 ELSE 0.0 END AS trend_strength,
         CASE WHEN vsd > 0 THEN (volume - vm) / vsd ELSE 0 END AS volume_zscore, volume / vm AS volume_ratio_ma, line / close * 100 AS macd_value, sig / close * 100 AS macd_signal, (line - sig) / close * 100 AS macd_hist,
         CASE WHEN pline < psig AND line > sig THEN 1.0 WHEN pline > psig AND line < sig THEN -1.0 ELSE 0.0 END AS macd_cross,
         volume / vm5 AS vol_ratio, (close / c4 - 1) * 100 AS chg_4b, coalesce((close / c119 - 1) * 100, 0) AS year_chg
  FROM fc WHERE idx = n)
"""

SCORE_SQL = """greatest(0, least(100, 65 + CASE WHEN macd_cross > 0 THEN 5 WHEN macd_cross < 0 THEN -5 ELSE 0 END + CASE WHEN rsi > 30 AND rsi < 70 THEN 5 WHEN rsi > 75 THEN -5 ELSE 0 END
  + CASE WHEN adx > 30 THEN 3 ELSE 0 END + CASE WHEN volume_zscore > 1.5 THEN 5 ELSE 0 END))::INTEGER"""
VOL_SIGNAL_SQL = f"CASE WHEN vol_ratio > 1.5 AND chg_4b < -3 THEN '{L.VOL_DOWN}' WHEN vol_ratio > 1.5 AND chg_4b > 3 THEN '{L.VOL_UP}' WHEN vol_ratio < 0.5 AND chg_4b > 3 THEN '{L.THIN_UP}' WHEN vol_ratio < 0.5 AND chg_4b < -3 THEN '{L.THIN_DOWN}' ELSE '{L.VOL_NORMAL}' END"
VOL_SCORE_SQL = f"CASE {VOL_SIGNAL_SQL} WHEN '{L.VOL_UP}' THEN 70 WHEN '{L.VOL_DOWN}' THEN 30 WHEN '{L.THIN_UP}' THEN 60 ELSE 50 END"


def latest(spark, sf):
    """The features of the last bars, short series included: windows that are not full give what they hold."""
    axis = replace(SERIES, partial=True)
    b = T.walk_bars(spark, sf).withColumn("year_chg", ind.year_change(axis))
    b = ind.price_features(b, axis, last=ind.REACH).withColumns(ind.volume_price(axis))
    return screen.last_bar(b).withColumn("zs_breakout_dir", F.lit(0.0))


@query("rule01_price_features", recursive(FEATURE_SQL + " SELECT symbol, " + ", ".join(f"round({f}, 4) + 0.0 AS {f}" for f in FEATURES) + " FROM feats"))
def price_features(spark, sf):
    return latest(spark, sf).select("symbol", *[r(f, 4) for f in FEATURES])


@query("rule01_structure_features")
def structure_features(spark, sf):
    s = shared.structure(spark, sf)
    return screen.structure_features(s, shared.points(spark, sf), ind.macd(s.bars))


@query("rule02_feature_score", recursive(FEATURE_SQL + f" SELECT symbol, {SCORE_SQL} AS score FROM feats"))
def feature_score(spark, sf):
    return latest(spark, sf).select("symbol", R.feature_score().alias("score"))


@query(
    "rule04_blend",
    recursive(FEATURE_SQL + f" SELECT symbol, score, vol_score, trunc(score * 0.6::DOUBLE + vol_score * 0.2::DOUBLE + 50 * 0.2::DOUBLE)::INTEGER AS final_score FROM (SELECT symbol, {SCORE_SQL} AS score, {VOL_SCORE_SQL} AS vol_score FROM feats)"),
)
def blend(spark, sf):
    x = latest(spark, sf)
    x = x.withColumn("score", R.feature_score()).withColumn("vol_signal", R.volume_signal()).withColumns({"vol_score": R.volume_score(), "sector_score": F.lit(50)})
    return x.select("symbol", "score", "vol_score", R.blend().alias("final_score"))


@query("rule05_extended_penalty", S(f" SELECT code, CASE WHEN k * 3 % 200 > 100 AND is_buy AND types NOT LIKE '%3%' THEN greatest(0, score - 15) ELSE score END AS score FROM sig"))
def extended(spark, sf):
    x = signals(spark, sf).withColumn("year_chg", F.col("k") * 3 % 200)
    return x.select("code", R.penalised().alias("score"))


@query(
    "rule06_second_pass",
    S(
        " SELECT code, CASE WHEN zone_low IS NULL THEN 'hold' WHEN is_buy AND price >= zone_low THEN 'buy' WHEN NOT is_buy AND types <> '' THEN 'sell' ELSE 'hold' END AS bucket,"
        " CASE WHEN zone_low IS NOT NULL AND is_buy AND price >= zone_low THEN CASE WHEN price <= zone_high THEN '盘整买' ELSE '三买' END END AS screen_label,"
        " CASE WHEN zone_low IS NOT NULL AND is_buy AND price >= zone_low THEN CASE WHEN price <= zone_high THEN 75 ELSE 70 END + CASE WHEN types LIKE '%3a%' OR types LIKE '%3b%' THEN 5 ELSE 0 END END AS screen_score FROM sig"
    ),
)
def second_pass(spark, sf):
    return signals(spark, sf).select("code", *[v.alias(k) for k, v in R.second_pass().items()])


@query("rule07_volume_price", recursive(FEATURE_SQL + f" SELECT symbol, {VOL_SIGNAL_SQL} AS vol_signal, {VOL_SCORE_SQL} AS vol_score FROM feats"))
def volume_price(spark, sf):
    x = latest(spark, sf).withColumn("vol_signal", R.volume_signal())
    return x.select("symbol", "vol_signal", R.volume_score().alias("vol_score"))


@query(
    "rule08_confirm",
    S(
        f""", z AS (SELECT *, split_part(split_part(zs, ',', -1), '~', 1) AS zl, split_part(split_part(zs, ',', -1), '~', 2) AS zh FROM sig)
        SELECT code, concat_ws(';', CASE WHEN position = '{L.INSIDE}' AND is_buy THEN '{L.CONFIRM_INSIDE}' END, CASE WHEN types LIKE '%3%' THEN '{L.CONFIRM_THIRD}' END,
          CASE WHEN position = '{L.BELOW}' AND is_buy THEN '{L.CONFIRM_BELOW}' END, CASE WHEN NOT is_buy AND types <> '' THEN '{L.CONFIRM_SELL}' END) AS confirmations,
          CASE WHEN is_buy THEN 'Buy' WHEN types <> '' THEN 'Sell' ELSE 'Hold' END AS direction,
          CASE WHEN position = '{L.INSIDE}' THEN '{L.RISK_LOW}' WHEN position = '{L.BELOW}' AND is_buy THEN '{L.RISK_HIGH}' WHEN NOT is_buy AND position = '{L.ABOVE}' THEN '{L.RISK_LOW}' ELSE '{L.RISK_MID}' END AS risk,
          CASE WHEN zs = '' THEN 0 WHEN is_buy THEN zh::DOUBLE ELSE zl::DOUBLE END AS target,
          CASE WHEN zs = '' THEN NULL WHEN is_buy THEN round((zh::DOUBLE - price) / price * 100, 4) ELSE round((price - zl::DOUBLE) / price * 100, 4) END + 0.0 AS profit_pct FROM z"""
    ),
)
def confirm(spark, sf):
    c = R.confirm()
    return signals(spark, sf).select("code", F.array_join(c["confirmations"], ";").alias("confirmations"), c["direction"].alias("direction"), c["risk"].alias("risk"), c["target"].alias("target"), r(c["profit_pct"], 4, "profit_pct"))


QTEXT = "concat(" + ", ".join(f"CASE WHEN types LIKE '%{k}%' THEN '{t}' ELSE '' END" for k, t in L.QUERY_PARTS) + ", CASE position " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in L.QUERY_POSITION.items()) + " ELSE '' END)"


@query("rule09_query_text", S(f" SELECT code, CASE WHEN {QTEXT} = '' THEN '{L.QUERY_DEFAULT}' ELSE {QTEXT} END AS query FROM sig"))
def query_text(spark, sf):
    return signals(spark, sf).select("code", R.query_text().alias("query"))


@query(
    "rule10_smart_money",
    S(
        f""", z AS (SELECT *, (TRY_CAST(split_part(split_part(zs, ',', 1), '~', 1) AS DOUBLE) + TRY_CAST(split_part(split_part(zs, ',', 1), '~', 2) AS DOUBLE)) / 2 AS mid FROM sig)
        SELECT code, concat_ws(';', CASE position WHEN '{L.BELOW}' THEN '{L.SMC_SHIFT}' WHEN '{L.INSIDE}' THEN '{L.SMC_RANGE}' END, CASE WHEN zs <> '' THEN '{L.SMC_BLOCK}' END,
          CASE position WHEN '{L.ABOVE}' THEN '{L.SMC_PREMIUM}' WHEN '{L.BELOW}' THEN '{L.SMC_DISCOUNT}' END, CASE WHEN zs LIKE '%,%' THEN '{L.SMC_POOL}' END, CASE WHEN abs(price - mid) > 0.05::DOUBLE * price THEN '{L.SMC_GAP}' END) AS insights,
          CASE WHEN is_buy AND position = '{L.BELOW}' THEN '{L.SMC_UP}' WHEN NOT is_buy AND position = '{L.ABOVE}' THEN '{L.SMC_DOWN}' ELSE '{L.SMC_NONE}' END AS verdict FROM z"""
    ),
)
def smart_money(spark, sf):
    c = R.smart_money()
    return signals(spark, sf).select("code", F.array_join(c["insights"], ";").alias("insights"), c["verdict"].alias("verdict"))


@query(
    "rule11_trade_levels",
    S(
        """ SELECT code, zone_low AS entry, round(zone_low * 0.97::DOUBLE, 4) AS stop, zone_high AS tp1, round(zone_high * 1.1::DOUBLE, 4) AS tp2,
        CASE WHEN zone_low IS NULL THEN 0 ELSE round((zone_high - zone_low) / (zone_low - zone_low * 0.97::DOUBLE), 4) END AS rr,
        round(abs(zone_high - zone_low) / greatest(abs(zone_low - trunc(zone_low * 0.97::DOUBLE)), 1), 4) AS rr_compat FROM sig"""
    ),
)
def trade_levels(spark, sf):
    t = R.trade_levels()
    return signals(spark, sf).select("code", t["entry"].alias("entry"), r(t["stop"], 4, "stop"), t["tp1"].alias("tp1"), r(t["tp2"], 4, "tp2"), r(t["rr"], 4, "rr"), r(R.rr_compat(), 4, "rr_compat"))


@query(
    "rule12_indicator_vote",
    recursive(
        MACD_SQL
        + f""", d AS (SELECT *, close - {lag('close')} AS diff FROM bars),
        g AS (SELECT symbol, day, idx, close, avg(greatest(diff, 0)) {back(14)} AS u, avg(greatest(-diff, 0)) {back(14)} AS v, avg(close) {back(20)} AS m20, stddev_pop(close) {back(20)} AS sd FROM d),
        s AS (SELECT g.symbol, g.day, CASE WHEN g.idx < 14 THEN 50 WHEN v = 0 THEN 100 ELSE round(100 - 100 / (1 + u / v), 1) END AS rsi, CASE WHEN g.idx >= 34 AND m.dif > m.dea THEN 1 ELSE 0 END AS bull,
                     CASE WHEN g.idx >= 19 AND sd > 0 AND round((g.close - m20 + 2 * sd) / (4 * sd) * 100, 0) < 20 THEN 1 ELSE 0 END AS low FROM g JOIN m ON m.symbol = g.symbol AND m.idx = g.idx),
        t AS (SELECT symbol, day, CASE WHEN rsi BETWEEN 30 AND 40 THEN 1 WHEN rsi < 20 THEN 2 ELSE 0 END + bull + low AS vote FROM s)
        SELECT symbol, day, vote, CASE WHEN vote >= 4 THEN 'strong_buy' WHEN vote = 3 THEN 'buy' WHEN vote = 2 THEN 'neutral' ELSE 'weak' END AS vote_signal FROM t"""
    ),
)
def indicator_vote(spark, sf):
    b = ind.with_moves(ind.macd_summary(T.walk_bars(spark, sf)), SERIES).withColumns(ind.bollinger_summary(SERIES))
    b = b.withColumn("rsi", F.round(ind.rsi_simple(SERIES, flat=100.0), 1))
    return b.select("symbol", "day", *[v.alias(k) for k, v in R.indicator_vote().items()])


SHORT_IN = f""", st AS (SELECT *, {LABEL_SQL} AS signal, (k * 11 % 100)::DOUBLE AS rsi, CASE WHEN k % 3 = 0 THEN 'bullish' ELSE 'bearish' END AS macd_trend, (k * 17 % 100)::DOUBLE AS bb_pos, (k % 30)::DOUBLE / 10 AS vol_ratio,
  (k % 12)::DOUBLE AS turnover, {lit(FLOWS)}[(1 + k % 5)::INTEGER] AS main_flow, k % 13 AS sector_strength, k % 12 AS news_score, {lit(REGIMES)}[(1 + k % 6)::INTEGER] AS market_regime FROM sig),
sp AS (SELECT *, greatest(0, least(10, 5 + CASE WHEN vol_ratio > 1.5 AND price > 0 THEN 3 WHEN vol_ratio < 0.8 THEN -2 ELSE 0 END + CASE WHEN turnover > 5 THEN 2 WHEN turnover < 1 THEN -1 ELSE 0 END)) AS quote_score,
  greatest(0, least(25, CASE WHEN signal LIKE '%{L.BUYS["1"]}%' THEN 15 WHEN signal LIKE '%{L.BUYS["2"]}%' THEN 12 WHEN signal LIKE '%{L.BUYS["3"]}%' THEN 10 WHEN signal LIKE '%Sell%' THEN -10 ELSE 5 END
    + CASE WHEN rsi BETWEEN 30 AND 40 THEN 3 WHEN rsi < 20 THEN 5 WHEN rsi > 80 THEN -4 ELSE 0 END + CASE WHEN macd_trend = 'bullish' THEN 3 ELSE -2 END + CASE WHEN bb_pos < 20 THEN 2 WHEN bb_pos > 80 THEN -2 ELSE 0 END)) AS tech_score,
  CASE main_flow WHEN 'strong_inflow' THEN 28 WHEN 'inflow' THEN 22 WHEN 'neutral' THEN 15 WHEN 'outflow' THEN 8 ELSE 5 END AS flow_score,
  greatest(0, least(15, 8 + CASE WHEN bb_pos < 30 AND rsi < 40 THEN 4 ELSE 0 END - CASE WHEN bb_pos > 70 AND rsi > 60 THEN 3 ELSE 0 END)) AS day_score, least(10, sector_strength) AS sector_part, least(10, news_score) AS news_part FROM st),
sq AS (SELECT *, CASE WHEN flow_score >= 24 AND rsi > 75 THEN 5 ELSE 0 END AS f1, CASE WHEN flow_score <= 8 AND tech_score >= 18 THEN 3 ELSE 0 END AS f2, CASE WHEN sector_part >= 8 AND flow_score <= 8 THEN 2 ELSE 0 END AS f3 FROM sp),
ss AS (SELECT *, greatest(0, least(100, quote_score + tech_score + flow_score + day_score + sector_part + news_part - f1 - f2 - f3)) AS total_score FROM sq)
"""


def short_inputs(spark, sf):
    k = F.col("k")
    return signals(spark, sf).withColumn("signal", R.signal_label()).withColumns(
        {
            "rsi": (k * 11 % 100).cast("double"), "macd_trend": F.when(k % 3 == 0, "bullish").otherwise("bearish"), "bb_pos": (k * 17 % 100).cast("double"), "vol_ratio": (k % 30).cast("double") / 10,
            "turnover": (k % 12).cast("double"), "main_flow": pick(FLOWS, k % 5), "sector_strength": k % 13, "news_score": k % 12, "market_regime": pick(REGIMES, k % 6),
        }
    )


@query(
    "rule13_short_term",
    S(SHORT_IN + f" SELECT code, quote_score, tech_score, flow_score, day_score, sector_part, news_part, total_score, concat_ws(';', CASE WHEN f1 > 0 THEN '{L.FIX_HOT}' END, CASE WHEN f2 > 0 THEN '{L.FIX_COLD}' END, CASE WHEN f3 > 0 THEN '{L.FIX_SECTOR}' END) AS corrections FROM ss"),
)
def short_term(spark, sf):
    c = R.short_term()
    return short_inputs(spark, sf).select("code", *[v.alias(n) for n, v in c.items() if n != "corrections"], F.array_join(c["corrections"], ";").alias("corrections"))


MATRIX = "matrix(regime, lim, grade, decision, pct) AS (VALUES " + ", ".join(f"('{n}', {a}, '{b}', '{c}', {d})" for n, steps in L.REGIMES.items() for a, b, c, d in steps) + ")"


@query(
    "rule14_regime_decision",
    "WITH " + MATRIX + ", " + SIG + SHORT_IN
    + f" SELECT code, total_score, arg_max(grade, lim) AS grade, arg_max(decision, lim) AS decision, arg_max(pct, lim) AS position_pct FROM ss JOIN matrix ON regime = CASE WHEN market_regime = '?' THEN '{L.DEFAULT_REGIME}' ELSE market_regime END AND total_score >= lim GROUP BY code, total_score",
)
def regime_decision(spark, sf):
    x = short_inputs(spark, sf).withColumn("total_score", R.short_term()["total_score"]).withColumn("d", R.regime_decision())
    return x.select("code", "total_score", "d.grade", "d.decision", "d.position_pct")


@query(
    "rule15_quick_decision",
    S(SHORT_IN.replace("(k * 11 % 100)::DOUBLE AS rsi", "50.0::DOUBLE AS rsi").replace("(k % 30)::DOUBLE / 10 AS vol_ratio", "1.0::DOUBLE AS vol_ratio").replace("(k % 12)::DOUBLE AS turnover", "2.0::DOUBLE AS turnover").replace(f"{lit(FLOWS)}[(1 + k % 5)::INTEGER] AS main_flow", "'neutral' AS main_flow").replace("k % 13 AS sector_strength", "5 AS sector_strength").replace("k % 12 AS news_score", "5 AS news_score").replace("CASE WHEN k % 3 = 0 THEN 'bullish' ELSE 'bearish' END AS macd_trend", "'neutral' AS macd_trend").replace("(k * 17 % 100)::DOUBLE AS bb_pos", "50.0::DOUBLE AS bb_pos") + " SELECT code, total_score FROM ss"),
)
def quick_decision(spark, sf):
    empty = lambda t: F.lit(None).cast(t)
    x = signals(spark, sf).withColumn("signal", R.signal_label()).withColumns(
        {"rsi": F.coalesce(empty("double"), F.lit(50.0)), "vol_ratio": F.lit(1.0), "turnover": F.lit(2.0), "main_flow": F.lit("neutral"), "sector_strength": F.lit(5), "news_score": F.lit(5), "macd_trend": F.lit("neutral"), "bb_pos": F.lit(50.0)}
    )
    return x.select("code", R.short_term()["total_score"].alias("total_score"))


LEADER_SQL = FEATURE_SQL + QUOTES + ", " + UNIVERSE + f""", pool AS (SELECT f.symbol, f.vol_ratio, q.change_pct * 5 AS change_pct, (abs(hash_k) * 7 % 40)::DOUBLE AS turnover, q.change_pct * 5 >= 9 AS limit_up, hash_k % 4 AS boards, u.sector
   FROM (SELECT *, symbol::BIGINT AS hash_k FROM feats) f JOIN quotes q USING (symbol) JOIN universe u USING (symbol)),
heat AS (SELECT sector, round(avg(change_pct), 2) AS chg, list(symbol ORDER BY change_pct DESC, symbol)[1:5] AS lead_list FROM pool WHERE sector NOT LIKE '%7' GROUP BY sector),
mkt AS (SELECT count_if(change_pct > 0) / greatest(count(*), 1) AS up_ratio, count_if(change_pct <= -9.9) AS limit_down FROM pool),
pj AS (SELECT p.*, h.chg, coalesce(h.lead_list, []) AS lead_list, m.*, p.boards % 2 = 0 AS in_zs, true AS has_zs, CASE p.boards WHEN 0 THEN '{L.BUYS["1"]}' WHEN 1 THEN '{L.BUYS["2"]}' WHEN 2 THEN 'Buy' ELSE 'Hold' END AS signal FROM pool p LEFT JOIN heat h USING (sector), mkt m),
pr AS (SELECT *, CASE WHEN list_contains(lead_list, symbol) THEN list_position(lead_list, symbol) - 1 ELSE len(lead_list) + 1 END AS rank FROM pj),
ps AS (SELECT *, CASE WHEN limit_up THEN 15 WHEN change_pct >= 7 THEN 10 ELSE 0 END + CASE WHEN vol_ratio >= 3 THEN 15 WHEN vol_ratio >= 2 THEN 12 WHEN vol_ratio >= 1.5 THEN 8 ELSE 0 END
  + CASE WHEN boards >= 3 THEN 15 WHEN boards = 2 THEN 12 WHEN boards = 1 THEN 8 ELSE 0 END + CASE WHEN turnover BETWEEN 5 AND 20 THEN 10 WHEN turnover >= 2 AND turnover < 5 THEN 6 WHEN turnover > 30 THEN 2 ELSE 0 END
  + CASE WHEN in_zs THEN 15 WHEN has_zs THEN 8 ELSE 0 END + CASE WHEN signal = '{L.BUYS["1"]}' THEN 10 WHEN signal = '{L.BUYS["2"]}' THEN 8 WHEN signal LIKE '%Buy%' THEN 4 ELSE 0 END
  + CASE WHEN chg >= 5 THEN 10 WHEN chg >= 2 THEN 6 WHEN chg > 0 THEN 3 ELSE 0 END + CASE WHEN rank = 0 THEN 10 WHEN rank <= 3 THEN 5 ELSE 0 END
  - CASE WHEN up_ratio < 0.3 THEN 10 WHEN up_ratio < 0.5 THEN 5 ELSE 0 END - CASE WHEN limit_down > 20 THEN 5 ELSE 0 END AS raw FROM pr),
lead_rows AS (SELECT symbol, sector, raw - CASE WHEN chg IS NULL AND limit_up THEN 10 ELSE 0 END AS final FROM ps WHERE raw >= 30),
leaders AS (SELECT symbol, sector, greatest(0, least(100, final))::INTEGER AS leader_score, CASE WHEN final >= 80 THEN 'S' WHEN final >= 60 THEN 'A' ELSE 'B' END AS leader_level FROM lead_rows)
"""


def sector_pool(spark, sf):
    """Change, sector, sector leaders and market breadth per symbol; needs the quotes only."""
    q = T.quotes(T.walk_bars(spark, sf)).select("symbol", (F.col("change_pct") * 5).alias("change_pct"))
    pool = cut(q.join(T.universe(spark, sf).select("symbol", "sector"), "symbol"))
    heat = C.sector_leaders(pool.filter(~F.endswith("sector", F.lit("7"))))
    market = C.breadth(pool).select((F.col("up_count") / F.greatest("total_count", F.lit(1))).alias("up_ratio"), "limit_down_count")
    return pool.join(heat, "sector", "left").crossJoin(F.broadcast(market))  # one row of market totals


def leader_rows(spark, sf):
    """Pool × structure × sector × market."""
    x = latest(spark, sf).select("symbol", "vol_ratio", F.col("symbol").cast("bigint").alias("k")).join(sector_pool(spark, sf), "symbol")
    x = x.withColumns({"turnover": (F.col("k") * 7 % 40).cast("double"), "limit_up": F.col("change_pct") >= 9, "boards": F.col("k") % 4})
    b = F.col("boards")
    struct = {"in_zs": b % 2 == 0, "has_zs": F.lit(True), "signal": F.when(b == 0, L.BUYS["1"]).when(b == 1, L.BUYS["2"]).when(b == 2, "Buy").otherwise("Hold")}
    return x.withColumns(struct).withColumns(R.leader()).filter("raw_score >= 30")


@query("rule16_leaders", recursive(LEADER_SQL + " SELECT symbol, leader_score, leader_level FROM leaders"))
def leaders(spark, sf):
    return leader_rows(spark, sf).select("symbol", F.col("leader_score").cast("int").alias("leader_score"), "leader_level")


@query("join09_leader_inputs", recursive(LEADER_SQL + " SELECT symbol, sector, chg AS sector_chg, array_to_string(lead_list, ',') AS lead_list, up_ratio, limit_down AS limit_down_count FROM pj"))
def leader_inputs(spark, sf):
    return sector_pool(spark, sf).select("symbol", "sector", "sector_chg", F.coalesce(F.array_join("leading", ","), F.lit("")).alias("lead_list"), "up_ratio", "limit_down_count")


ADVICE = "advice(lv, action, pos) AS (VALUES " + ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in L.ADVICE.items()) + ")"


@query("rule17_leader_advice", recursive(LEADER_SQL + ", " + ADVICE + " SELECT symbol, leader_level, action, pos AS position FROM leaders JOIN advice ON lv = CASE WHEN leader_level = 'S' AND leader_score >= 80 THEN 'S' WHEN leader_level = 'A' OR (leader_level = 'S' AND leader_score >= 60) THEN 'A' ELSE 'B' END"))
def leader_advice(spark, sf):
    rows = [(k, v[0], v[1]) for k, v in L.ADVICE.items()]
    table = spark.createDataFrame(rows, "lv string, action string, position string")
    x = leader_rows(spark, sf).withColumn("lv", R.advice_level())
    return x.join(F.broadcast(table), "lv").select("symbol", "leader_level", "action", "position")


@query("top10_leaders_sorted", recursive(LEADER_SQL + " SELECT symbol, leader_score, (row_number() OVER (ORDER BY leader_score DESC, symbol))::INTEGER AS rank FROM leaders"))
def leaders_sorted(spark, sf):
    x = leader_rows(spark, sf).withColumn("leader_score", F.col("leader_score").cast("int"))
    return screen.rank_by_score(x, "leader_score").select("symbol", "leader_score", "rank")


FUND = "WITH " + FUNDAMENTALS
CTD = "cash / greatest(debt, 1)"


def fails_sql(name: str) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {CTD if c == 'cash_to_debt' else c} {op} {lim} THEN '{c}{op}{lim}' END" for c, op, lim in L.PRESETS[name]) + ")"


@query("rule18_presets", FUND + " " + " UNION ALL ".join(f"SELECT code, '{n}' AS preset, {fails_sql(n)} = '' AS passed, {fails_sql(n)} AS reasons FROM fundamentals" for n in L.PRESETS))
def presets(spark, sf):
    f = T.fundamentals(spark, sf)
    one = lambda n: F.struct(F.lit(n).alias("preset"), R.failed_rules(n).alias("failed"))
    x = f.select("code", F.explode(F.array(*[one(n) for n in L.PRESETS])).alias("p"))
    return x.select("code", "p.preset", (F.size("p.failed") == 0).alias("passed"), F.array_join("p.failed", ";").alias("reasons"))


QUALITY_SQL = """greatest(0, least(100, CASE WHEN roe >= 25 THEN 30 WHEN roe >= 20 THEN 25 WHEN roe >= 15 THEN 20 WHEN roe >= 10 THEN 10 WHEN roe >= 5 THEN 5 ELSE 0 END
 + CASE WHEN gross_margin >= 60 THEN 20 WHEN gross_margin >= 40 THEN 15 WHEN gross_margin >= 30 THEN 10 WHEN gross_margin >= 20 THEN 5 ELSE 0 END
 + CASE WHEN revenue_growth >= 30 THEN 15 WHEN revenue_growth >= 20 THEN 12 WHEN revenue_growth >= 10 THEN 8 WHEN revenue_growth >= 0 THEN 3 ELSE 0 END
 + CASE WHEN pe > 0 AND pe <= 10 THEN 15 WHEN pe <= 15 THEN 12 WHEN pe <= 20 THEN 8 WHEN pe <= 30 THEN 4 WHEN pe > 50 THEN -5 ELSE 0 END
 + CASE WHEN debt_ratio <= 20 THEN 10 WHEN debt_ratio <= 40 THEN 8 WHEN debt_ratio <= 60 THEN 4 ELSE 0 END + CASE WHEN fcf > 0 THEN 10 WHEN operating_cf > 0 THEN 5 ELSE 0 END))::INTEGER"""


@query("rule19_quality", FUND + f" SELECT code, {QUALITY_SQL} AS quality FROM fundamentals")
def quality(spark, sf):
    return T.fundamentals(spark, sf).select("code", R.quality_score().alias("quality"))


@query("rule20_best_preset", FUND + " SELECT code, CASE " + " ".join(f"WHEN {fails_sql(n)} = '' THEN '{n}'" for n in L.PRESETS) + f" ELSE '{L.NO_MATCH}' END AS preset, {QUALITY_SQL} AS quality FROM fundamentals")
def best_preset(spark, sf):
    return T.fundamentals(spark, sf).select("code", R.best_preset().alias("preset"), R.quality_score().alias("quality"))


@query("rule31_business_quality", FUND + " SELECT code, (CASE WHEN roe > 15 THEN 1 ELSE 0 END + CASE WHEN gross_margin > 40 THEN 1 ELSE 0 END + CASE WHEN fcf > 0 THEN 1 ELSE 0 END)::INTEGER AS checks FROM fundamentals")
def business_quality(spark, sf):
    return T.fundamentals(spark, sf).select("code", R.business_quality().alias("checks"))


@query(
    "rule21_main_line",
    S(
        """, m AS (SELECT code, greatest(0, least(10, (k % 140)::DOUBLE / 10)) * 10 * 0.4::DOUBLE + score * 0.3::DOUBLE + greatest(0, least(100, 100 - abs(k % 60 - 40))) * 0.2::DOUBLE + k % 100 * 0.1::DOUBLE AS t FROM sig)
        SELECT code, round(t, 4) AS main_line, CASE WHEN t >= 55 THEN 'first' WHEN t >= 50 THEN 'second' ELSE 'defensive' END AS tier FROM m"""
    ),
)
def main_line(spark, sf):
    x = signals(spark, sf).withColumns({"rr": (F.col("k") % 140).cast("double") / 10, "entry_dist": F.col("k") % 60 - 40, "sector_score": F.col("k") % 100})
    m = R.main_line()
    return x.select("code", r(m["main_line"], 4, "main_line"), m["tier"].alias("tier"))


@query("rule22_actionable", S(f" SELECT code, coalesce(is_buy AND abs(price - zone_low) / price * 100 <= 15 AND (position = '{L.INSIDE}' OR (position = '{L.BELOW}' AND types LIKE '%2%')), false) AS actionable FROM sig"))
def actionable(spark, sf):
    return signals(spark, sf).select("code", F.coalesce(R.actionable(entry="zone_low"), F.lit(False)).alias("actionable"))


@query(
    "rule23_chase_risk",
    S(f", l AS (SELECT *, {LABEL_SQL} AS signal FROM sig) SELECT code, CASE WHEN zone_low IS NULL AND signal LIKE 'Sell%' THEN 'top_risk' WHEN signal LIKE 'Sell%' THEN 'reject' WHEN k % 120 > 80 OR k % 15 > 10 THEN 'do_not_chase' WHEN signal = '{L.BUYS['1']}' AND score < 55 THEN 'caution' ELSE 'ok' END AS risk FROM l"),
)
def chase_risk(spark, sf):
    x = signals(spark, sf).withColumn("signal", R.signal_label()).withColumns({"year_chg": F.col("k") % 120, "chg_5": F.col("k") % 15, "has_zone": F.col("zone_low").isNotNull()})
    return x.select("code", R.chase_risk().alias("risk"))


AUCTION_SQL = f""", o AS (SELECT *, (open / {lag('close')} - 1) * 100 + (close / open - 1) * 20 AS gap, volume / 10 / avg(volume) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS share FROM bars)
"""


@query(
    "rule24_auction",
    with_bars(
        AUCTION_SQL
        + " SELECT symbol, day, CASE WHEN gap > 0.5 AND share > 0.2 THEN 'grab' WHEN gap < -0.5 AND share < 0.05 THEN 'ignored' WHEN abs(gap) <= 0.5 AND share > 0.2 THEN 'contested' ELSE 'normal' END AS auction,"
        " CASE WHEN gap < 0 AND close > open THEN 'probe_then_buy' WHEN close - open > gap THEN 'pushed_up' WHEN close - open > 0 AND close - open < gap THEN 'healthy_digest' ELSE 'none' END AS transition FROM o"
    ),
)
def auction(spark, sf):
    b = T.walk_bars(spark, sf)
    w = SERIES.w()
    gap = (F.col("open") / F.lag("close", 1).over(w) - 1) * 100 + (F.col("close") / F.col("open") - 1) * 20
    b = b.withColumns({"gap_pct": gap, "vol_share": F.col("volume") / 10 / F.avg("volume").over(w.rowsBetween(-20, -1)), "move": F.col("close") - F.col("open")})
    return b.select("symbol", "day", R.auction_class().alias("auction"), R.auction_transition("gap_pct", "move", "gap_pct", "move").alias("transition"))


@query(
    "rule27_accumulation",
    with_bars(
        f""", v AS (SELECT symbol, day, close, volume, open, avg(volume) {back(20)} AS v20, avg(volume) {back(60)} AS v60, avg(CASE WHEN close > open THEN volume END) {back(20)} AS up, avg(CASE WHEN close < open THEN volume END) {back(20)} AS dn,
             list(CASE WHEN close > open THEN volume END) {back(20)} AS recent, (close / min(low) {back(60)} - 1) * 100 AS dist FROM bars),
        s AS (SELECT symbol, day, CASE WHEN v20 > v60 * 1.3::DOUBLE THEN 2 ELSE 0 END + CASE WHEN up > dn * 1.3::DOUBLE THEN 2 ELSE 0 END + CASE WHEN len(list_filter(recent, lambda x: x > v20 * 1.5)) >= 3 THEN 2 ELSE 0 END + CASE WHEN dist < 10 THEN 2 ELSE 0 END AS acc_score FROM v)
        SELECT symbol, day, acc_score, CASE WHEN acc_score >= 6 THEN 'strong' WHEN acc_score >= 4 THEN 'medium' WHEN acc_score >= 2 THEN 'weak' ELSE 'none' END AS acc_class FROM s"""
    ),
)
def accumulation(spark, sf):
    b = T.walk_bars(spark, sf).withColumns({**ind.accumulation_inputs(SERIES), **ind.up_down_volume(SERIES)}).withColumn("surge", ind.surge_days(SERIES))
    return b.select("symbol", "day", *[v.alias(k) for k, v in R.accumulation().items()])


@query(
    "agg11_up_down_volume",
    with_bars(
        f""", v AS (SELECT symbol, day, avg(volume) {back(20)} AS v20, avg(CASE WHEN close > open THEN volume END) {back(20)} AS up, avg(CASE WHEN close < open THEN volume END) {back(20)} AS dn, list(CASE WHEN close > open THEN volume END) {back(20)} AS recent FROM bars)
        SELECT symbol, day, round(up, 4) AS up_vol, round(dn, 4) AS down_vol, len(list_filter(recent, lambda x: x > v20 * 1.5))::INTEGER AS surge FROM v"""
    ),
)
def up_down(spark, sf):
    b = T.walk_bars(spark, sf).withColumns({**ind.up_down_volume(SERIES), **ind.accumulation_inputs(SERIES)})
    return b.select("symbol", "day", r("up_vol", 4), r("down_vol", 4), ind.surge_days(SERIES).alias("surge"))


FUSION = "fusion(s, f, g, action, size) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e})" for a, b, c, d, e in L.FUSION) + ")"
STATES = ["buy", "none", "oscillation", "sell", "unclear"]
MONEY = ["positive", "weak", "mixed"]
NEWS = ["resonant", "none", "hot", "mixed"]


CONFIDENCE = ["high", "medium", "low"]


@query(
    "rule28_fusion",
    "WITH " + FUSION + f""", x AS (SELECT c_custkey AS code, {lit(STATES)}[(1 + c_custkey % 5)::INTEGER] AS st, {lit(MONEY)}[(1 + c_custkey // 5 % 3)::INTEGER] AS mo, {lit(NEWS)}[(1 + c_custkey // 15 % 4)::INTEGER] AS ne,
      {lit(CONFIDENCE)}[(1 + c_custkey // 60 % 3)::INTEGER] AS conf, CASE WHEN c_custkey // 7 % 2 = 0 THEN 'strong' ELSE 'weak' END AS market, c_custkey % 11 = 0 AS reentry FROM customer)
    SELECT code, st, mo, ne, conf, market, reentry, CASE WHEN reentry AND st <> 'sell' THEN 'observe' ELSE coalesce(action, 'observe') END AS action, CASE WHEN reentry THEN 0 ELSE coalesce(size, 0) END::DOUBLE AS size,
      CASE WHEN st = 'sell' THEN -5 WHEN reentry THEN -3 WHEN st = 'buy' AND mo = 'positive' AND ne = 'resonant' AND conf = 'high' THEN 5 WHEN st = 'buy' THEN 2 ELSE 0 END AS modifier,
      CASE WHEN st = 'sell' THEN 'exit' WHEN reentry OR conf = 'low' THEN 'none' WHEN conf = 'medium' THEN 'micro' WHEN market = 'strong' THEN 'existing' ELSE 'half' END AS cap
    FROM x LEFT JOIN fusion ON s = st AND f IN ('any', mo) AND g IN ('any', ne)""",
)
def fusion(spark, sf):
    k = F.col("c_custkey")
    x = T.load(spark, sf, "customer").select(
        k.alias("code"), pick(STATES, k % 5).alias("st"), pick(MONEY, F.floor(k / 5) % 3).alias("mo"), pick(NEWS, F.floor(k / 15) % 4).alias("ne"),
        pick(CONFIDENCE, F.floor(k / 60) % 3).alias("conf"), F.when(F.floor(k / 7) % 2 == 0, "strong").otherwise("weak").alias("market"), (k % 11 == 0).alias("reentry"),
    )
    return x.withColumns(R.fusion())


@query(
    "rule30_confidence",
    S(
        """, x AS (SELECT code, k % 60 AS n, k % 4 <> 0 AS sub, k % 3 <> 0 AS sure, zone_low IS NOT NULL AS z, types <> '' AS p FROM sig)
        SELECT code, CASE WHEN n < 30 THEN 'low' WHEN z AND p AND sure AND sub THEN 'high' WHEN z THEN 'medium' ELSE 'low' END AS confidence,
               concat_ws(';', CASE WHEN n < 30 THEN 'short_history' END, CASE WHEN NOT sub THEN 'no_lower_level' END, CASE WHEN NOT sure THEN 'tail_unconfirmed' END) AS limits FROM x"""
    ),
)
def confidence(spark, sf):
    k = F.col("k")
    x = signals(spark, sf).withColumns({"n_bars": k % 60, "has_sub": k % 4 != 0, "tail_sure": k % 3 != 0, "has_zone": F.col("zone_low").isNotNull(), "has_point": F.col("types") != ""})
    c = R.confidence()
    return x.select("code", c["confidence"].alias("confidence"), F.array_join(c["limits"], ";").alias("limits"))


@query("join13_two_levels", S(", w AS (SELECT code AS wcode, k % 3 = 0 AS sub_buy FROM sig WHERE k % 4 <> 0) SELECT code, CASE WHEN is_buy AND coalesce(sub_buy, false) THEN 'both' WHEN is_buy THEN 'daily_only' WHEN coalesce(sub_buy, false) THEN 'lower_only' ELSE 'none' END AS confirm FROM sig LEFT JOIN w ON wcode = code"))
def two_levels(spark, sf):
    s = signals(spark, sf)
    lower = s.filter(F.col("k") % 4 != 0).select("code", (F.col("k") % 3 == 0).alias("sub_buy"))
    x = s.join(lower, "code", "left").withColumn("sub_buy", F.coalesce("sub_buy", F.lit(False)))
    return x.select("code", R.two_levels().alias("confirm"))


SESSION_SQL = """
m5 AS (SELECT event_type AS symbol, ts::DATE AS day, strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%H%M') AS time, arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2, 3),
sess AS (SELECT symbol, day, sum(volume) AS total, sum(CASE WHEN time >= '0930' AND time <= '1000' THEN volume ELSE 0 END) AS a, sum(CASE WHEN time > '1000' AND time <= '1130' THEN volume ELSE 0 END) AS b,
                sum(CASE WHEN time >= '1300' AND time <= '1430' THEN volume ELSE 0 END) AS c, sum(CASE WHEN time > '1430' AND time < '1500' THEN volume ELSE 0 END) AS d FROM m5 GROUP BY 1, 2)
"""


def sessions(spark, sf):
    from barflow.plans.intraday import session_shares
    from barflow.registry.bars import minute_bars

    return session_shares(minute_bars(spark, sf))


@query("agg03_session_shares", "WITH " + SESSION_SQL + " SELECT symbol, day, total AS total_vol, round(a / total * 100, 4) AS morning_pct, round(b / total * 100, 4) AS mid_pct, round(c / total * 100, 4) AS afternoon_pct, round(d / total * 100, 4) AS tail_pct FROM sess")
def session_shares(spark, sf):
    return sessions(spark, sf).select("symbol", "day", "total_vol", *[r(c, 4) for c in ("morning_pct", "mid_pct", "afternoon_pct", "tail_pct")])


@query(
    "rule25_session_signals",
    "WITH " + SESSION_SQL + ", p AS (SELECT symbol, day, a / total * 100 AS o, d / total * 100 AS t FROM sess) SELECT symbol, day, concat_ws(';', CASE WHEN o > 30 THEN 'opening_grab' WHEN o > 20 THEN 'opening_active' END, CASE WHEN t > 25 THEN 'tail_surge' WHEN t > 15 THEN 'tail_active' END) AS signals FROM p",
)
def session_signals(spark, sf):
    return sessions(spark, sf).select("symbol", "day", F.array_join(R.session_signals(), ";").alias("signals"))


@query("top04_top5_volume_bars", "WITH " + SESSION_SQL + " SELECT symbol, day, time, volume, (close * 100)::BIGINT AS price_cents FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY volume DESC, time) AS k FROM m5) WHERE k <= 5")
def top5_volume(spark, sf):
    from barflow.plans.intraday import top_volume
    from barflow.registry.bars import minute_bars

    return top_volume(minute_bars(spark, sf)).select("symbol", "day", "time", "volume", F.round(F.col("close") * 100).cast("bigint").alias("price_cents"))


T0_DAY = "OVER (PARTITION BY symbol, day ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "rule26_intraday_action",
    f"""WITH hbars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2),
    hb AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM hbars),
    s AS (SELECT symbol, ts, close AS p, max(high) {T0_DAY} AS hi, min(low) {T0_DAY} AS lo, avg(close) {back(20)} AS ma, volume / avg(volume) {T0_DAY} AS v, ['bull', 'bear', 'neutral'][(1 + hour(ts) % 3)::INTEGER] AS bias FROM hb),
    t AS (SELECT *, CASE WHEN bias IN ('bull', 'neutral') THEN CASE WHEN p < lo * 1.005::DOUBLE THEN 'add_low' WHEN p < ma AND v > 1.3 THEN 'add_below_mean' WHEN bias = 'bull' AND p > hi * 0.98::DOUBLE AND p < hi AND v < 0.6 THEN 'reduce_thin_high' END END AS a,
          CASE WHEN bias IN ('bear', 'neutral') THEN CASE WHEN p > hi * 0.995::DOUBLE THEN 'reduce_high' WHEN v > 1.5 THEN 'reduce_spike' END END AS c FROM s)
    SELECT symbol, ts, coalesce(c, a) AS action FROM t""",
)
def intraday_action(spark, sf):
    from barflow.registry.indicators import DAY_AXIS, hour_series

    b = hour_series(spark, sf).withColumns(ind.day_stats(DAY_AXIS, SERIES)).withColumn("bias", pick(["bull", "bear", "neutral"], F.hour("ts") % 3))
    return b.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), R.intraday_action().alias("action"))
