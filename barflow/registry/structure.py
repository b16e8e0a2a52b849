"""STR rows and STM-02: merged bars, fractals, strokes, segments, zones, strengths, points and what was known after each bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import indicators as ind
from barflow.operators import structure as S
from barflow.operators.structure import lines as LN
from barflow.operators.structure import points as P
from barflow.operators.structure.strength import with_strengths
from barflow.plans import screen
from barflow.registry import shared
from barflow.registry.core import query, r
from barflow.registry.prelude import HOURS, recursive
from barflow.session import cut, in_place
from barflow.sources import tables as T

# The inclusion merge as a recursion over bars: one state row per bar.
MERGE_SQL = """, mg AS (
  SELECT symbol, idx, high AS h, low AS l, 1 AS dir, 0 AS mb, high AS bh, low AS bl, idx AS hi_bar, idx AS lo_bar FROM bars WHERE idx = 0
  UNION ALL
  SELECT symbol, idx, nh, nl, ndir, nmb, bh, bl, CASE WHEN bh = nh THEN idx ELSE hi_bar END, CASE WHEN bl = nl THEN idx ELSE lo_bar END
  FROM (
    SELECT symbol, idx, bh, bl, hi_bar, lo_bar, CASE WHEN rel = 0 THEN dir ELSE rel END AS ndir, CASE WHEN rel = 0 THEN mb ELSE mb + 1 END AS nmb,
           CASE WHEN rel <> 0 THEN bh WHEN keep THEN h WHEN dir = 1 THEN greatest(h, bh) ELSE least(h, bh) END AS nh,
           CASE WHEN rel <> 0 THEN bl WHEN keep THEN l WHEN dir = 1 THEN greatest(l, bl) ELSE least(l, bl) END AS nl
    FROM (
      SELECT b.symbol, b.idx, m.h, m.l, m.dir, m.mb, b.high AS bh, b.low AS bl, m.hi_bar, m.lo_bar,
             CASE WHEN m.h > b.high AND m.l > b.low THEN -1 WHEN m.h < b.high AND m.l < b.low THEN 1 ELSE 0 END AS rel,
             b.high = b.low AND CASE WHEN m.dir = 1 THEN b.high = m.h ELSE b.low = m.l END AS keep
      FROM mg m JOIN bars b ON b.symbol = m.symbol AND b.idx = m.idx + 1))),
merged AS (
  SELECT symbol, mb AS mb_idx, min(idx) AS first_bar, max(idx) AS last_bar, arg_max(h, idx) AS high, arg_max(l, idx) AS low, any_value(dir) AS dir,
         arg_max(hi_bar, idx) AS hi_bar, arg_max(lo_bar, idx) AS lo_bar, max(bh) AS max_high, min(bl) AS min_low, count(*)::INTEGER AS n_bars, arg_min(bh, idx) AS first_high, arg_min(bl, idx) AS first_low
  FROM mg GROUP BY symbol, mb),
fx AS (
  SELECT *, CASE WHEN lag(high) OVER w < high AND lead(high) OVER w < high AND lag(low) OVER w < low AND lead(low) OVER w < low THEN 'top'
                 WHEN lag(high) OVER w > high AND lead(high) OVER w > high AND lag(low) OVER w > low AND lead(low) OVER w > low THEN 'bottom' ELSE 'none' END AS fractal,
         coalesce(lead(max_high) OVER w < min_low OR lead(min_low) OVER w > max_high, false) AS gap,
         lag(high) OVER w AS ph, lag(low) OVER w AS pl, lead(high) OVER w AS nh, lead(low) OVER w AS nl,
         lead(first_high) OVER w AS nfh, lead(first_low) OVER w AS nfl
  FROM merged WINDOW w AS (PARTITION BY symbol ORDER BY mb_idx))
"""

def merged(spark, sf):
    return S.merged_bars(T.walk_bars(spark, sf))


@query("str01_merged_bars", recursive(MERGE_SQL + " SELECT symbol, mb_idx, first_bar, last_bar, high, low, dir, max_high, min_low, n_bars FROM merged"))
def merged_bars(spark, sf):
    return merged(spark, sf).select("symbol", "mb_idx", "first_bar", "last_bar", "high", "low", "dir", "max_high", "min_low", "n_bars")


@query("str02_fractals", recursive(MERGE_SQL + " SELECT symbol, mb_idx, fractal FROM fx"))
def fractals(spark, sf):
    return S.fractals(merged(spark, sf)).select("symbol", "mb_idx", "fractal")


@query("str03_peak_bars", recursive(MERGE_SQL + " SELECT symbol, mb_idx, hi_bar, lo_bar FROM merged"))
def peak_bars(spark, sf):
    return merged(spark, sf).select("symbol", "mb_idx", "hi_bar", "lo_bar")


@query("str04_gap_to_next", recursive(MERGE_SQL + " SELECT symbol, mb_idx, gap FROM fx"))
def gap_to_next(spark, sf):
    return S.gap_to_next(merged(spark, sf)).select("symbol", "mb_idx", "gap")


PAIR_SQL = """, f AS (SELECT *, lead(mb_idx) OVER w AS b_idx, lead(fractal) OVER w AS bf, lead(high) OVER w AS bh, lead(low) OVER w AS bl, lead(ph) OVER w AS bph, lead(pl) OVER w AS bpl,
  lead(nh) OVER w AS bnh, lead(nl) OVER w AS bnl FROM fx WHERE fractal <> 'none' WINDOW w AS (PARTITION BY symbol ORDER BY mb_idx))
SELECT symbol, mb_idx, b_idx,
  CASE WHEN fractal = 'top' THEN high > greatest(bph, bh, bnh) AND bl < least(pl, low, nl) ELSE low < least(bpl, bl, bnl) AND bh > greatest(ph, high, nh) END AS strict,
  CASE WHEN fractal = 'top' THEN high > bh AND bl < low ELSE low < bl AND bh > high END AS loss,
  CASE WHEN fractal = 'top' THEN high > greatest(bph, bh) AND bl < least(low, nl) ELSE low < least(bpl, bl) AND bh > greatest(high, nh) END AS half,
  CASE WHEN fractal = 'top' THEN low > greatest(bph, bh, bnh) ELSE high < least(bpl, bl, bnl) END AS totally
FROM f WHERE bf <> fractal
"""


@query("str05_fractal_pairs", recursive(MERGE_SQL + PAIR_SQL))
def fractal_pairs(spark, sf):
    return LN.fractal_pairs(S.fractals(merged(spark, sf)))


@query(
    "str06_stroke_span",
    recursive(MERGE_SQL + ", f AS (SELECT *, lead(mb_idx) OVER (PARTITION BY symbol ORDER BY mb_idx) AS b_idx FROM fx WHERE fractal <> 'none') SELECT f.symbol, f.mb_idx, f.b_idx, (f.b_idx - f.mb_idx)::INTEGER AS span, (f.b_idx - f.mb_idx + count_if(g.gap))::INTEGER AS span_gaps, f.b_idx - f.mb_idx >= 4 AS strict_ok FROM f JOIN fx g ON g.symbol = f.symbol AND g.mb_idx >= f.mb_idx AND g.mb_idx < f.b_idx WHERE f.b_idx IS NOT NULL GROUP BY f.symbol, f.mb_idx, f.b_idx"),
)
def stroke_span(spark, sf):
    return LN.fractal_spans(S.gap_to_next(S.fractals(merged(spark, sf))))


@query(
    "str07_end_is_peak",
    recursive(
        MERGE_SQL
        + ", f AS (SELECT *, lead(mb_idx) OVER w AS b_idx, lead(high) OVER w AS bh, lead(low) OVER w AS bl FROM fx WHERE fractal <> 'none' WINDOW w AS (PARTITION BY symbol ORDER BY mb_idx)) SELECT f.symbol, f.mb_idx, f.b_idx, count(m.mb_idx) = 0 AS is_peak FROM f LEFT JOIN merged m ON m.symbol = f.symbol AND m.mb_idx > f.mb_idx AND m.mb_idx < f.b_idx AND CASE WHEN f.fractal = 'top' THEN m.low < f.bl ELSE m.high > f.bh END WHERE f.b_idx IS NOT NULL GROUP BY f.symbol, f.mb_idx, f.b_idx"
    ),
)
def end_is_peak(spark, sf):
    return LN.ends_are_peaks(S.fractals(merged(spark, sf)))


# strokes as a recursion over fractals; those before the last one
STROKE_SQL = (
    MERGE_SQL
    + """, f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mb_idx) AS k FROM fx WHERE fractal <> 'none'),
        fm AS MATERIALIZED (SELECT symbol, list(low ORDER BY mb_idx) AS lows, list(high ORDER BY mb_idx) AS highs FROM merged GROUP BY symbol),
        ok AS MATERIALIZED (
          SELECT a.symbol, a.k AS ka, b.k AS kb FROM f a JOIN f b ON a.symbol = b.symbol AND b.k > a.k AND a.fractal <> b.fractal AND b.mb_idx - a.mb_idx >= 4
          JOIN fm ON fm.symbol = a.symbol
          WHERE CASE WHEN a.fractal = 'top' THEN a.high > greatest(b.ph, b.high, b.nfh) AND b.low < least(a.pl, a.low, a.nl)
                     ELSE a.low < least(b.pl, b.low, b.nfl) AND b.high > greatest(a.ph, a.high, a.nh) END
            AND CASE WHEN a.fractal = 'top' THEN list_min(lows[a.mb_idx + 2 : b.mb_idx]) >= b.low ELSE list_max(highs[a.mb_idx + 2 : b.mb_idx]) <= b.high END),
        start AS (SELECT symbol, ka, kb FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY kb, ka) AS n FROM ok) WHERE n = 1),
        st AS (
          SELECT symbol, kb AS k, 0 AS stroke, ka AS a, kb AS b FROM start
          UNION ALL
          SELECT st.symbol, st.k + 1,
                 CASE WHEN x.fractal <> e.fractal AND o.kb IS NOT NULL THEN st.stroke + 1 ELSE st.stroke END,
                 CASE WHEN x.fractal <> e.fractal AND o.kb IS NOT NULL THEN st.b ELSE st.a END,
                 CASE WHEN x.fractal <> e.fractal THEN CASE WHEN o.kb IS NOT NULL THEN x.k ELSE st.b END
                      WHEN CASE WHEN x.fractal = 'top' THEN x.high >= e.high ELSE x.low <= e.low END THEN x.k ELSE st.b END
          FROM st JOIN f x ON x.symbol = st.symbol AND x.k = st.k + 1 JOIN f e ON e.symbol = st.symbol AND e.k = st.b
          LEFT JOIN ok o ON o.symbol = st.symbol AND o.ka = st.b AND o.kb = x.k),
        done AS (SELECT symbol, stroke, arg_max(a, k) AS a, arg_max(b, k) AS b FROM st GROUP BY symbol, stroke),
        sk AS MATERIALIZED (
        SELECT d.symbol, d.stroke::INTEGER AS idx, CASE WHEN fa.fractal = 'bottom' THEN 1 ELSE -1 END AS dir, fa.mb_idx AS begin_mb, fb.mb_idx AS end_mb,
               CASE WHEN fa.fractal = 'bottom' THEN fa.low ELSE fa.high END AS begin_val, CASE WHEN fa.fractal = 'bottom' THEN fb.high ELSE fb.low END AS end_val
        FROM done d JOIN f fa ON fa.symbol = d.symbol AND fa.k = d.a JOIN f fb ON fb.symbol = d.symbol AND fb.k = d.b
        WHERE d.stroke < (SELECT max(stroke) FROM done z WHERE z.symbol = d.symbol)),
        sb AS (
          SELECT sk.*, greatest(begin_val, end_val) AS high, least(begin_val, end_val) AS low, x.first_bar, y.last_bar,
                 CASE WHEN sk.dir = 1 THEN x.lo_bar ELSE x.hi_bar END AS begin_bar, CASE WHEN sk.dir = 1 THEN y.hi_bar ELSE y.lo_bar END AS end_bar
          FROM sk JOIN merged x ON x.symbol = sk.symbol AND x.mb_idx = sk.begin_mb JOIN merged y ON y.symbol = sk.symbol AND y.mb_idx = sk.end_mb)
"""
)


# The strokes shown after each bar: the confirmed ones, and what the newest merged bars make of the last one.
REPLAY_SQL = STROKE_SQL + """,
        told AS (SELECT st.symbol, m.first_bar AS t, st.stroke AS s, st.a, st.b FROM st JOIN f ON f.symbol = st.symbol AND f.k = st.k JOIN merged m ON m.symbol = f.symbol AND m.mb_idx = f.mb_idx + 1),
        now AS (
          SELECT g.symbol, g.idx AS t, g.mb, g.h, g.l, g.dir AS mdir, g.hi_bar, g.lo_bar,
                 last_value(told.s IGNORE NULLS) OVER w AS s, last_value(told.a IGNORE NULLS) OVER w AS a, last_value(told.b IGNORE NULLS) OVER w AS b
          FROM mg g LEFT JOIN told ON told.symbol = g.symbol AND told.t = g.idx WINDOW w AS (PARTITION BY g.symbol ORDER BY g.idx)),
        e AS MATERIALIZED (
          SELECT n.*, fa.mb_idx AS a_mb, fb.mb_idx AS b_mb, fb.fractal = 'top' AS up, fb.high AS eh, fb.low AS el, least(fb.pl, fb.low, fb.nl) AS near_low, greatest(fb.ph, fb.high, fb.nh) AS near_high,
                 CASE WHEN fb.fractal = 'top' THEN h >= fb.high ELSE l <= fb.low END AS beyond
          FROM now n JOIN f fa ON fa.symbol = n.symbol AND fa.k = n.a JOIN f fb ON fb.symbol = n.symbol AND fb.k = n.b),
        cand AS (
          SELECT e.symbol, e.t, m.mb_idx, CASE WHEN m.mb_idx = e.mb THEN e.h ELSE m.high END AS mh, CASE WHEN m.mb_idx = e.mb THEN e.l ELSE m.low END AS ml,
                 CASE WHEN m.mb_idx = e.mb THEN e.hi_bar ELSE m.hi_bar END AS mhi, CASE WHEN m.mb_idx = e.mb THEN e.lo_bar ELSE m.lo_bar END AS mlo
          FROM e JOIN merged m ON m.symbol = e.symbol AND m.mb_idx BETWEEN e.b_mb + 4 AND e.mb WHERE NOT e.beyond AND m.dir = CASE WHEN e.up THEN -1 ELSE 1 END),
        late AS (
          SELECT c.symbol, c.t, max(c.mb_idx) AS mb_idx, arg_max(CASE WHEN e.up THEN ml ELSE mh END, c.mb_idx) AS v, arg_max(CASE WHEN e.up THEN mlo ELSE mhi END, c.mb_idx) AS bar
          FROM cand c JOIN e ON e.symbol = c.symbol AND e.t = c.t JOIN merged p ON p.symbol = c.symbol AND p.mb_idx = c.mb_idx - 1 JOIN fm ON fm.symbol = c.symbol
          WHERE CASE WHEN e.up THEN e.eh > greatest(mh, p.high) AND ml < near_low AND list_min(lows[e.b_mb + 2 : c.mb_idx]) >= ml
                     ELSE e.el < least(ml, p.low) AND mh > near_high AND list_max(highs[e.b_mb + 2 : c.mb_idx]) <= mh END
          GROUP BY c.symbol, c.t),
        ends AS (SELECT symbol, mb_idx, high, low, hi_bar, lo_bar FROM merged),
        shown AS (
          SELECT e.symbol, s AS idx, t, CASE WHEN up THEN 1 ELSE -1 END AS dir, NOT beyond AS is_sure, a_mb AS begin_mb, CASE WHEN beyond THEN mb ELSE b_mb END AS end_mb,
                 CASE WHEN up THEN x.lo_bar ELSE x.hi_bar END AS begin_bar, CASE WHEN beyond THEN CASE WHEN up THEN e.hi_bar ELSE e.lo_bar END WHEN up THEN y.hi_bar ELSE y.lo_bar END AS end_bar,
                 CASE WHEN up THEN x.low ELSE x.high END AS begin_val, CASE WHEN beyond THEN CASE WHEN up THEN h ELSE l END WHEN up THEN eh ELSE el END AS end_val, false AS stays
          FROM e JOIN ends x ON x.symbol = e.symbol AND x.mb_idx = a_mb JOIN ends y ON y.symbol = e.symbol AND y.mb_idx = b_mb
          UNION ALL
          SELECT e.symbol, s + 1, e.t, CASE WHEN up THEN -1 ELSE 1 END, false, b_mb, late.mb_idx, CASE WHEN up THEN y.hi_bar ELSE y.lo_bar END, late.bar, CASE WHEN up THEN eh ELSE el END, late.v, false
          FROM e JOIN late ON late.symbol = e.symbol AND late.t = e.t JOIN ends y ON y.symbol = e.symbol AND y.mb_idx = b_mb
          UNION ALL
          SELECT sb.symbol, sb.idx, z.t, sb.dir, true, begin_mb, end_mb, begin_bar, end_bar, begin_val, end_val, true
          FROM sb JOIN (SELECT symbol, s, min(t) AS t FROM told GROUP BY symbol, s) z ON z.symbol = sb.symbol AND z.s = sb.idx + 1),
        island AS (
          SELECT *, t - row_number() OVER (PARTITION BY symbol, idx, dir, is_sure, begin_mb, end_mb, begin_bar, end_bar, begin_val, end_val ORDER BY t) AS run FROM shown),
        latest AS (SELECT symbol, max(idx) AS last FROM bars GROUP BY symbol)
"""
_SHOWN = "SELECT i.symbol, i.idx::INTEGER AS idx, dir, is_sure, begin_mb, end_mb, begin_bar, end_bar, begin_val, end_val"
_ISLANDS = " FROM island i JOIN latest ON latest.symbol = i.symbol GROUP BY i.symbol, i.idx, dir, is_sure, begin_mb, end_mb, begin_bar, end_bar, begin_val, end_val, run"
_STAYS = "bool_or(stays) OR max(t) = any_value(last)"


@query("stm02_replay", recursive(REPLAY_SQL + _SHOWN + f", min(t) AS from_bar, CASE WHEN {_STAYS} THEN NULL ELSE max(t) END AS to_bar" + _ISLANDS))
def replay(spark, sf):
    """Every stroke version with the bars after which it was shown, for every bar of every series."""
    v = S.stroke_versions(T.walk_bars(spark, sf)).select("*", F.when(F.col("up"), 1).otherwise(-1).alias("dir"))
    named = {"is_sure": "sure", "begin_mb": "ref_a", "end_mb": "ref_b", "begin_bar": "a_bar", "end_bar": "b_bar", "begin_val": "begin", "end_val": "end"}
    v = v.select("symbol", "pos", "dir", *[F.col(old).alias(new) for new, old in named.items()], "from_bar", "to_bar")
    return S.compact(v, ["dir", *named]).withColumnRenamed("pos", "idx")


#: the strokes of hourly bars after the last one
HOUR_STROKES = "WITH RECURSIVE " + HOURS + ", bars AS (SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::INTEGER AS idx, high, low FROM hbars)" + REPLAY_SQL + _SHOWN + _ISLANDS + " HAVING " + _STAYS


@query("str08_strokes", recursive(STROKE_SQL + " SELECT * FROM sk"))
def strokes(spark, sf):
    """All strokes but the last confirmed one, whose end the unconfirmed tail may move. The merged bar after an
    end counts with its first bar only, since that is all that is known when the end is confirmed."""
    s = shared.structure(spark, sf).strokes
    return LN.settled(s).select("symbol", "idx", "dir", "begin_mb", "end_mb", "begin_val", "end_val")


@query("str09_unconfirmed_tail")
def tail(spark, sf):
    return shared.structure(spark, sf).strokes.filter(~F.col("is_sure"))


@query("str10_stroke_attributes")
def stroke_attributes(spark, sf):
    return LN.stroke_attributes(shared.structure(spark, sf).strokes)


@query(
    "str10_settled_attributes",
    recursive(STROKE_SQL + """ SELECT symbol, idx, dir, begin_bar, end_bar, begin_val, end_val, abs(end_val - begin_val) AS amp, (end_bar - begin_bar + 1)::INTEGER AS bar_cnt,
  (end_mb - begin_mb + 1)::INTEGER AS merged_cnt, (high + low) / 2 AS mid FROM sb"""),
)
def settled_attributes(spark, sf):
    x = LN.stroke_attributes(LN.settled(shared.structure(spark, sf).strokes))
    return x.select("symbol", "idx", "dir", "begin_bar", "end_bar", "begin_val", "end_val", "amp", "bar_cnt", "merged_cnt", "mid")


@query(
    "str11_settled_strengths",
    recursive(STROKE_SQL + """, v AS (
  SELECT s.symbol, s.idx, sum(b.turnover) AS amount, sum(b.volume) AS volume FROM sb s JOIN bars b ON b.symbol = s.symbol AND b.idx BETWEEN s.first_bar AND s.last_bar GROUP BY s.symbol, s.idx)
SELECT s.symbol, s.idx, (high - low) / high / (end_bar - begin_bar + 1) AS slope, (high - low) / CASE WHEN dir = 1 THEN low ELSE high END AS amp, round(v.amount, 2) AS amount,
  round(v.amount, 2) / (end_bar - begin_bar + 1) AS amount_avg, v.volume AS volumn, v.volume / (end_bar - begin_bar + 1) AS volumn_avg, round(v.volume / 1000 / (end_bar - begin_bar + 1), 9) AS turnrate_avg
FROM sb s JOIN v ON v.symbol = s.symbol AND v.idx = s.idx"""),
)
def settled_strengths(spark, sf):
    s = shared.structure(spark, sf)
    b = s.bars.withColumn("turnover_rate", F.col("volume") / 1000)
    with in_place(spark):
        x = cut(with_strengths(LN.settled(s.strokes), b, {"slope", "amp", "amount", "amount_avg", "volumn", "volumn_avg", "turnrate_avg"}))
    n = F.col("end_bar") - F.col("begin_bar") + 1
    same = [F.col(f"in_{k}").alias(k) for k in ("slope", "amp", "volumn", "volumn_avg")]
    # money adds up in any order, so its cents are fixed before the division
    return x.select("symbol", "idx", *same, F.round("in_amount", 2).alias("amount"), (F.round(F.col("in_amount_avg") * n, 2) / n).alias("amount_avg"), F.round("in_turnrate_avg", 9).alias("turnrate_avg"))


@query("str11_strengths")
def strengths(spark, sf):
    s = shared.structure(spark, sf)
    with in_place(spark):
        b = ind.rsi_wilder(ind.macd(s.bars)).withColumn("turnover_rate", F.col("volume") / 1000)
        return cut(with_strengths(s.strokes, b, set(S.config.STRENGTHS)))


@query("str14_segments")
def segments(spark, sf):
    return shared.structure(spark, sf).segments


@query("str15_leftover_all")
def leftover_all(spark, sf):
    return shared.structure(spark, sf, {"left_seg_method": "all"}).segments


@query("str16_segments_one_plus_one")
def one_plus_one(spark, sf):
    return shared.structure(spark, sf, {"seg_algo": "1+1"}).segments


@query("str17_segments_break")
def seg_break(spark, sf):
    return shared.structure(spark, sf, {"seg_algo": "break"}).segments


@query("str18_segments_of_segments")
def segsegs(spark, sf):
    return shared.structure(spark, sf).segsegs


@query("str19_segment_attributes")
def segment_attributes(spark, sf):
    return LN.segment_attributes(shared.structure(spark, sf).segments)


@query("str20_trend_lines")
def trend_lines(spark, sf):
    s = shared.structure(spark, sf)
    return LN.trend_lines(s.strokes, s.bare_segments)


@query("str21_zones")
def zones(spark, sf):
    return shared.structure(spark, sf).zones


@query("str22_zones_over_seg")
def zones_over_seg(spark, sf):
    return shared.structure(spark, sf, {"zs_algo": "over_seg"}).zones


@query("str22_zones_auto")
def zones_auto(spark, sf):
    return shared.structure(spark, sf, {"zs_algo": "auto", "one_bi_zs": True}).zones


@query("str24_zones_peak_merge")
def zones_peak(spark, sf):
    return shared.structure(spark, sf, {"zs_combine_mode": "peak"}).zones


@query("str25_zone_in_segment")
def zone_in_segment(spark, sf):
    s = shared.structure(spark, sf)
    return LN.zones_in_segments(s.zones, s.bare_segments, s.strokes)


@query("str26_divergence")
def divergence(spark, sf):
    p = shared.points(spark, sf)
    return p.select("symbol", "line", "is_buy", F.element_at("features", "divergence_rate").alias("rate")).filter("rate IS NOT NULL")


@query("str27_exit_is_peak")
def exit_is_peak(spark, sf):
    s = shared.structure(spark, sf)
    g = s.bare_segments.select("symbol", F.col("idx").alias("g"), "dir", "is_sure", F.col("begin_stroke").alias("begin"), F.col("end_stroke").alias("end"))
    table = P._line_table(with_strengths(s.strokes, None, {"amp"}), {"amp"})
    return P.zone_exits(P._groups(g, s.zones), table)


@query("str28_34_points")
def points(spark, sf):
    return shared.points(spark, sf)


@query("str35_segment_points")
def segment_points(spark, sf):
    return shared.points(spark, sf, level="segment")


@query("str36_points_by_side")
def points_by_side(spark, sf):
    return shared.points(spark, sf, {"divergence_rate": 0.7, "min_zs_cnt": 0, "macd_algo-buy": "area", "macd_algo-sell": "slope", "bsp2_follow_1": False, "bsp3_follow_1": False, "bsp3_peak-sell": True})


@query("str37_summary")
def summary(spark, sf):
    s = shared.structure(spark, sf)
    return screen.summary(s, shared.points(spark, sf), s.bars)


@query("str39_recent_buys")
def recent_buys(spark, sf):
    s = shared.structure(spark, sf)
    return LN.recent_buys(shared.points(spark, sf), s.bars, days=30)


@query("str40_tidy_tables")
def tidy(spark, sf):
    s = shared.structure(spark, sf)
    return LN.tidy(s, shared.points(spark, sf), shared.points(spark, sf, level="segment"))


@query("top06_latest_points")
def latest(spark, sf):
    return P.latest_points(shared.points(spark, sf), 3)


@query("top09_highest_zones")
def highest_zones(spark, sf):
    z = screen.top_zones(shared.structure(spark, sf).zones).filter("from_top <= 2")
    return z.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("zones"))


@query("join15_bars_in_strokes")
def bars_in_strokes(spark, sf):
    from barflow.operators.structure.strength import bars_of_lines

    s = shared.structure(spark, sf)
    x = bars_of_lines(s.strokes, s.bars, ["volume"]).filter("idx BETWEEN begin_bar AND end_bar")
    return x.groupBy("symbol", "line").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))


@query(
    "join15_settled_strokes",
    recursive(STROKE_SQL + " SELECT s.symbol, s.idx AS line, count(*) AS bars, sum(b.volume) AS volume FROM sb s JOIN bars b ON b.symbol = s.symbol AND b.idx BETWEEN s.begin_bar AND s.end_bar GROUP BY s.symbol, s.idx"),
)
def bars_in_settled_strokes(spark, sf):
    s = LN.settled(shared.structure(spark, sf).strokes).select("symbol", F.col("idx").alias("line"))
    return bars_in_strokes(spark, sf).join(s, ["symbol", "line"])


@query("join17_lower_level_merged")
def lower_level(spark, sf):
    return LN.lower_level_merged(spark, sf)


@query("ind13_14_setup_countdown")
def setup_countdown(spark, sf):
    from barflow.operators.sequences import setups

    return setups(T.walk_bars(spark, sf))


@query("rule29_structure_state")
def structure_state(spark, sf):
    s = shared.structure(spark, sf)
    return LN.structure_state(s.zones, s.bare_segments)
