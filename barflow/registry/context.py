"""JOIN, AGG, TOP, SET, PF, MKT, MAC, HK and SNK rows over quotes, sectors, themes and positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.functions import labels as L
from barflow.operators import indicators as ind
from barflow.operators.scan import SERIES
from barflow.plans import context as C
from barflow.plans import portfolio as PF
from barflow.plans import screen
from barflow.registry import shared
from barflow.registry.bars import BOARD_SQL, board_rows
from barflow.registry.core import query, r
from barflow.registry.indicators import MOMENTUM_SQL, SHORT_SQL, back, lag
from barflow.registry.prelude import POSITIONS, QUOTES, THEMES, UNIVERSE, recursive, with_bars
from barflow.registry.rules import FEATURE_SQL, SCORE_SQL, VOL_SCORE_SQL, VOL_SIGNAL_SQL
from barflow.sources import tables as T

Q = lambda body, *more: with_bars(body, QUOTES, *more)
UNI = ", " + UNIVERSE
HEAT = """, heat AS (SELECT sector, round(avg(change_pct), 2) AS chg, count_if(change_pct > 0) AS up, count(*) - count_if(change_pct > 0) AS dn,
  greatest(0, least(100, trunc(50 + avg(change_pct) * 10 + count_if(change_pct > 0) / count(*) * 30)::INTEGER)) AS score FROM quotes JOIN universe USING (symbol) GROUP BY sector)
"""


def quotes(spark, sf):
    return T.quotes(T.walk_bars(spark, sf))


def heat(spark, sf):
    return C.sector_heat(quotes(spark, sf), T.universe(spark, sf))


@query("join01_names", Q(" SELECT q.symbol, q.price, coalesce(u.name, '?') AS name FROM quotes q LEFT JOIN (SELECT * FROM universe WHERE symbol NOT LIKE '%3') u USING (symbol)", UNI))
def names(spark, sf):
    u = T.universe(spark, sf).filter(~F.endswith("symbol", F.lit("3"))).select("symbol", "name")
    return quotes(spark, sf).join(u, "symbol", "left").select("symbol", "price", F.coalesce("name", F.lit("?")).alias("name"))


SUBS = "subs AS (SELECT n_name AS sector, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 1)"


@query("join02_parent_sector", f"WITH {UNIVERSE}, {SUBS} SELECT symbol, u.sector, coalesce(s.parent, '{L.OTHER}') AS top_sector FROM universe u LEFT JOIN subs s USING (sector)")
def parent_sector(spark, sf):
    """Stock -> sub-sector -> parent, the second map as an array per parent, as the mapping is kept."""
    n, rg = T.load(spark, sf, "nation"), T.load(spark, sf, "region")
    kept = n.filter(F.col("n_nationkey") % 4 != 1).join(rg, n.n_regionkey == rg.r_regionkey)
    parents = kept.groupBy(F.col("r_name").alias("top_sector")).agg(F.collect_list("n_name").alias("children"))
    pairs = parents.select("top_sector", F.explode("children").alias("sector"))
    return T.universe(spark, sf).join(pairs, "sector", "left").select("symbol", "sector", F.coalesce("top_sector", F.lit(L.OTHER)).alias("top_sector"))


@query("join03_first_sector", f"WITH {THEMES} SELECT symbol, arg_min(theme, ord) AS sector FROM (SELECT symbol, unnest(string_split(themes, '|')) AS theme, unnest(range(len(string_split(themes, '|')))) AS ord FROM themes) GROUP BY symbol")
def first_sector(spark, sf):
    t = T.themes(spark, sf).select("symbol", F.posexplode(F.split("themes", r"\|")).alias("ord", "theme"))
    return t.groupBy("symbol").agg(F.min_by("theme", "ord").alias("sector"))


SEATS = """
seats AS (SELECT l_shipdate::DATE AS day, l_returnflag AS variety, CASE WHEN l_linestatus = 'F' THEN l_returnflag || '综合' ELSE l_returnflag || l_linenumber END AS contract,
  sum(l_quantity * 10)::BIGINT AS long_oi, sum(l_linenumber * 60)::BIGINT AS short_oi FROM lineitem GROUP BY 1, 2, 3),
days AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM (SELECT DISTINCT day FROM seats ORDER BY day DESC LIMIT 2)),
pk AS (SELECT variety, k, arg_max(row(long_oi, short_oi), row(CASE WHEN contract LIKE '%综合%' THEN 1 ELSE 0 END, contract)) AS p FROM seats JOIN days USING (day) GROUP BY 1, 2),
net AS (SELECT a.variety, a.p[1] AS l, a.p[2] AS s, coalesce(a.p[1] - b.p[1], 0) AS lc, coalesce(a.p[2] - b.p[2], 0) AS sc FROM (SELECT * FROM pk WHERE k = 1) a LEFT JOIN (SELECT * FROM pk WHERE k = 2) b USING (variety))
"""


@query("src20_seats", "WITH " + SEATS + " SELECT day, variety, contract, long_oi, short_oi FROM seats WHERE day >= DATE '2000-01-01'")
def seats(spark, sf):
    return C.seats(spark, sf).filter(F.col("day") >= F.lit("2000-01-01").cast("date"))


@query("join07_mac04_net_positions", "WITH " + SEATS + f" SELECT variety, l AS long_oi, s AS short_oi, l - s AS net, lc AS long_chg, sc AS short_chg, lc - sc AS net_chg, CASE WHEN lc - sc > 1000 THEN '{L.LONG}' WHEN lc - sc < -1000 THEN '{L.SHORT}' ELSE '{L.NEUTRAL}' END AS direction FROM net")
def net_positions(spark, sf):
    return C.net_positions(C.seats(spark, sf))


@query("join08_set04_surge_and_point", Q(" SELECT symbol FROM quotes WHERE change_pct > 0 INTERSECT SELECT symbol FROM universe WHERE parent IN ('ASIA', 'EUROPE', 'AFRICA')", UNI))
def surge_and_point(spark, sf):
    a = quotes(spark, sf).filter("change_pct > 0").select("symbol")
    b = T.universe(spark, sf).filter(F.col("parent").isin("ASIA", "EUROPE", "AFRICA")).select("symbol")
    return a.distinct().join(b, "symbol", "left_semi")


@query("set04_surge_in_zone")
def surge_in_zone(spark, sf):
    """Surging volume ∩ in-zone buy, on real structure."""
    s = shared.structure(spark, sf)
    in_zone = screen.summary(s, shared.points(spark, sf), s.bars).filter(F.col("is_buy") & (F.col("position") == L.INSIDE)).select("symbol")
    surge = screen.last_bar(ind.tail(s.bars, SERIES, ind.REACH).withColumns(ind.volume_price(SERIES))).filter("vol_ratio > 1.0").select("symbol")
    return surge.intersect(in_zone)


@query("join10_heat_and_flow", Q(", flow AS (SELECT n_name AS sector, round(sum(s_acctbal), 2) AS net FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0 GROUP BY 1) SELECT h.sector, h.chg + 0.0 AS chg, h.score, f.net FROM heat h LEFT JOIN flow f USING (sector)", UNI, HEAT))
def heat_and_flow(spark, sf):
    s, n = T.load(spark, sf, "supplier"), T.load(spark, sf, "nation")
    flow = s.join(n.filter("n_nationkey % 3 <> 0"), s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("sector")).agg(F.round(F.sum("s_acctbal"), 2).alias("net"))
    return heat(spark, sf).join(flow, "sector", "left").select("sector", r("chg", 2), "score", "net")


@query("join12_futures_for_stocks", Q(f""", fut AS (SELECT parent AS tag, CASE WHEN change_pct > 0 THEN '↑' ELSE '↓' END AS trend FROM quotes JOIN universe USING (symbol) WHERE symbol::INTEGER % 9 = 0),
  types AS (SELECT DISTINCT sector AS stock_type, parent AS tag FROM universe) SELECT stock_type, count(f.tag) AS n, count_if(coalesce(f.trend = '↑', false)) AS ups,
  CASE WHEN count(f.tag) = 0 THEN '无相关期货数据' WHEN count_if(f.trend = '↑') > count(f.tag) / 2 THEN '{L.LONG}' WHEN count_if(f.trend = '↑') < count(f.tag) / 2 THEN '{L.SHORT}' ELSE '{L.NEUTRAL}' END AS summary FROM types LEFT JOIN fut f USING (tag) GROUP BY stock_type""", UNI))
def futures_for_stocks(spark, sf):
    u = T.universe(spark, sf)
    fut = quotes(spark, sf).filter(F.col("symbol").cast("int") % 9 == 0).join(u, "symbol").select(F.col("parent").alias("tag"), F.when(F.col("change_pct") > 0, "↑").otherwise("↓").alias("trend"))
    types = u.select(F.col("sector").alias("stock_type"), F.col("parent").alias("tag")).distinct()
    return C.futures_for_stocks(types, fut)


ROLE = "CASE r_name " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in C.ROLES.items()) + " ELSE r_name END"
SCALE = "CASE r_name " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in C.ROLES.items()) + " ELSE 1 END::DOUBLE"
MACRO = f"""
ms AS (SELECT {ROLE} AS name, o_orderdate::DATE AS day, avg(o_totalprice) / any_value({SCALE}) AS close, max(o_totalprice) / any_value({SCALE}) AS high, min(o_totalprice) / any_value({SCALE}) AS low
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
mk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY day DESC) AS k FROM ms),
mp AS (SELECT name, max(CASE WHEN k = 1 THEN close END) AS px, max(CASE WHEN k = 5 THEN close END) AS p5, max(CASE WHEN k = 20 THEN close END) AS p20, max(CASE WHEN k = 1 THEN high END) AS hi, max(CASE WHEN k = 1 THEN low END) AS lo FROM mk WHERE k <= 20 GROUP BY name HAVING count(*) >= 2),
macro AS (SELECT name, round(px, 2) AS value, round((px - coalesce(p5, px)) / coalesce(p5, px) * 100, 2) + 0.0 AS chg_5d, round((px - coalesce(p20, px)) / coalesce(p20, px) * 100, 2) + 0.0 AS chg_20d,
  CASE WHEN px > coalesce(p20, px) THEN '↑' ELSE '↓' END AS trend, round(hi, 2) AS day_high, round(lo, 2) AS day_low FROM mp),
mrow AS (SELECT max(CASE WHEN name = 'DXY' THEN value END) AS dxy, max(CASE WHEN name = 'VIX' THEN value END) AS vix, max(CASE WHEN name = 'US10Y' THEN value END) AS us10, max(CASE WHEN name = 'US3M' THEN value END) AS us3m, max(CASE WHEN name = 'USDCNY' THEN chg_5d END) AS cny5 FROM macro)
"""


@query("src21_macro_series", "WITH " + MACRO + " SELECT name, day, round(close, 8) AS close, round(high, 8) AS high, round(low, 8) AS low FROM ms")
def macro_series(spark, sf):
    return C.macro_series(spark, sf).select("name", "day", r("close", 8), r("high", 8), r("low", 8))


@query("ind29_macro_summary", "WITH " + MACRO + " SELECT * FROM macro")
def macro_summary(spark, sf):
    m = C.macro_summary(C.macro_series(spark, sf))
    return m.select("name", "value", r("chg_5d", 2), r("chg_20d", 2), "trend", "day_high", "day_low")


def macro_row(spark, sf):
    return C.macro_row(C.macro_summary(C.macro_series(spark, sf)), ["DXY", "VIX", "US10Y", "US3M", "USDCNY"])


@query(
    "mac01_macro_bias",
    "WITH " + MACRO + f""", s AS (SELECT concat_ws(',', CASE WHEN dxy > 101 THEN '{L.USD_STRONG}' WHEN dxy < 98 THEN '{L.USD_WEAK}' END, CASE WHEN vix > 25 THEN '{L.PANIC}' WHEN vix < 18 THEN '{L.CALM}' END, CASE WHEN us10 > 4.5 THEN '{L.HIGH_RATE}' END) AS signals FROM mrow)
    SELECT signals, CASE WHEN signals = '' THEN '{L.NEUTRAL}' WHEN signals LIKE '%强%' THEN '{L.SHORT}' ELSE '{L.LONG}' END AS bias FROM s""",
)
def macro_bias(spark, sf):
    b = C.macro_bias()
    return macro_row(spark, sf).select(F.array_join(b["signals"], ",").alias("signals"), b["bias"].alias("bias"))


@query(
    "mac02_curve_and_risk",
    "WITH " + MACRO + f" SELECT round(us10 - us3m, 4) + 0.0 AS spread_10y_3m, CASE WHEN us10 - us3m < 0 THEN '{L.INVERTED}' ELSE '{L.NORMAL}' END AS curve, CASE WHEN vix > 30 THEN '极度恐慌' WHEN vix > 25 THEN '恐慌' WHEN vix > 20 THEN '偏恐慌' WHEN vix > 15 THEN '正常' ELSE '极度乐观' END AS vix_class, CASE WHEN dxy > 101 THEN '强势' WHEN dxy < 98 THEN '弱势' ELSE '中性' END AS dxy_class, cny5 > 0.3 AS fx_pressure FROM mrow",
)
def curve_and_risk(spark, sf):
    c = C.curve_and_risk()
    return macro_row(spark, sf).select(r(c["spread_10y_3m"], 4, "spread_10y_3m"), *[c[k].alias(k) for k in ("curve", "vix_class", "dxy_class", "fx_pressure")])


@query(
    "join16_mac03_yield_spread",
    "WITH " + MACRO + """, p AS (SELECT day, max(CASE WHEN name = 'US10Y' THEN close END) AS a, max(CASE WHEN name = 'US3M' THEN close END) AS b FROM ms WHERE name IN ('US10Y', 'US3M') GROUP BY day),
    f AS (SELECT day, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM p WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING))
    SELECT day, round(a - b, 4) + 0.0 AS spread, CASE WHEN a - b > 2.5 THEN 'outflow' WHEN a - b > 2 THEN 'wide' ELSE 'normal' END AS spread_class FROM f WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def yield_spread(spark, sf):
    return C.yield_spread(C.macro_series(spark, sf), "US10Y", "US3M").select("day", r("spread", 4), "spread_class")


@query("src22_bond_yields", "WITH " + MACRO + " SELECT arg_max(round(close, 4), day) FILTER (name = 'US10Y') AS y10, arg_max(round(close, 4), day) FILTER (name = 'US3M') AS y2, arg_max(round(close, 4), day) FILTER (name = 'USDCNY') AS y30 FROM ms")
def bond_yields(spark, sf):
    last = lambda n: F.max_by(F.when(F.col("name") == n, F.round("close", 4)), F.when(F.col("name") == n, F.col("day")))
    return C.macro_series(spark, sf).agg(last("US10Y").alias("y10"), last("US3M").alias("y2"), last("USDCNY").alias("y30"))


# ---- aggregations ---------------------------------------------------------------------------------------------


@query("agg04_sector_heat", Q(" SELECT sector, chg + 0.0 AS chg, up, dn, score FROM heat", UNI, HEAT))
def sector_heat(spark, sf):
    return heat(spark, sf).select("sector", r("chg", 2), "up", "dn", "score")


@query("agg05_breadth", Q(" SELECT count_if(change_pct > 0) AS up_count, count_if(change_pct < 0) AS down_count, count(*) AS total_count, count_if(change_pct <= -9.9) AS limit_down_count FROM quotes"))
def breadth(spark, sf):
    return C.breadth(quotes(spark, sf))


TH = ", " + THEMES + ", tr AS (SELECT symbol, unnest(string_split(themes, '|')) AS theme FROM themes)"


def theme_rows(spark, sf):
    from barflow.sources.vendors import exploded_themes

    return exploded_themes(T.themes(spark, sf))


@query("agg06_theme_counts", Q(" SELECT theme, count(*) AS stocks, count_if(change_pct > 0) AS buys FROM tr JOIN quotes USING (symbol) GROUP BY theme", TH))
def theme_counts(spark, sf):
    x = theme_rows(spark, sf).join(quotes(spark, sf), "symbol")
    return x.groupBy("theme").agg(F.count("*").alias("stocks"), F.count_if(F.col("change_pct") > 0).alias("buys"))


@query("agg07_cross_boards", f"WITH {THEMES}, tr AS (SELECT symbol, unnest(string_split(themes, '|')) AS theme FROM themes) SELECT symbol, count(DISTINCT theme) AS boards, string_agg(DISTINCT theme, '/' ORDER BY theme) AS names FROM tr GROUP BY symbol HAVING count(DISTINCT theme) >= 3")
def cross_boards(spark, sf):
    g = theme_rows(spark, sf).groupBy("symbol").agg(F.count_distinct("theme").alias("boards"), F.array_join(F.sort_array(F.collect_set("theme")), "/").alias("names"))
    return g.filter("boards >= 3")


@query("agg08_themes_of_stock", f"WITH {THEMES}, tr AS (SELECT symbol, unnest(string_split(themes, '|')) AS theme FROM themes) SELECT symbol, string_agg(theme, ', ' ORDER BY theme) AS themes FROM tr GROUP BY symbol")
def themes_of_stock(spark, sf):
    return theme_rows(spark, sf).groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_list("theme")), ", ").alias("themes"))


@query("agg12_alpha_beta", with_bars(f""", i AS (SELECT day, avg(ret) AS m FROM (SELECT day, close / {lag('close')} - 1 AS ret FROM bars) GROUP BY day), s AS (SELECT symbol, day, close / {lag('close')} - 1 AS ret FROM bars)
  SELECT symbol, round(regr_slope(ret, m), 4) + 0.0 AS beta, round(regr_intercept(ret, m) * 252 * 100, 2) + 0.0 AS alpha_pct FROM s JOIN i USING (day) WHERE ret IS NOT NULL GROUP BY symbol"""))
def alpha_beta(spark, sf):
    b = T.walk_bars(spark, sf).withColumn("ret", F.col("close") / ind.prev(SERIES, "close", 1) - 1).filter("ret IS NOT NULL").select("symbol", "day", "ret")
    index = b.groupBy("day").agg(F.avg("ret").alias("m"))
    x = b.join(index, "day")
    return x.groupBy("symbol").agg(r(F.regr_slope("ret", "m"), 4, "beta"), r(F.regr_intercept("ret", "m") * 252 * 100, 2, "alpha_pct"))


@query(
    "agg13_expiry_histogram",
    """WITH e AS (SELECT (TIMESTAMP '2020-10-15 14:30:00' + INTERVAL 30 SECOND * (o_orderkey * 97 % 5000000))::DATE AS day FROM orders), h AS (SELECT day, count(*) AS n FROM e GROUP BY day),
    c AS (SELECT *, sum(n) OVER (ORDER BY day) AS cum, (SELECT sum(n) FROM h) AS total FROM h) SELECT day, n, day = (SELECT min(day) FROM c WHERE cum > total // 2) AS is_median FROM c""",
)
def expiry_histogram(spark, sf):
    from barflow.plans.expiry import epoch_day, histogram

    o = T.load(spark, sf, "orders").select((F.col("o_orderkey") * 97 % 5000000).alias("epoch"))
    return histogram(o.select(epoch_day(F.col("epoch")).alias("day")))


@query("agg14_funnel", Q(" SELECT count(*) AS total, count_if(change_pct > 0) AS rising, count_if(change_pct > 0 AND volume > 30) AS surging, count_if(change_pct > 0 AND volume > 30 AND price > 100000) AS kept FROM quotes"))
def funnel(spark, sf):
    up, v, p = F.col("change_pct") > 0, F.col("volume") > 30, F.col("price") > 100000
    return quotes(spark, sf).agg(F.count("*").alias("total"), F.count_if(up).alias("rising"), F.count_if(up & v).alias("surging"), F.count_if(up & v & p).alias("kept"))


@query("agg15_set02_distinct_codes", f"WITH {THEMES} SELECT DISTINCT symbol FROM (SELECT symbol, unnest(string_split(themes, '|')) FROM themes)")
def distinct_codes(spark, sf):
    return theme_rows(spark, sf).select("symbol").distinct()


# ---- sorting and sets -----------------------------------------------------------------------------------------


@query("top01_by_abs_change", Q(" SELECT symbol, change_pct, row_number() OVER (ORDER BY abs(change_pct) DESC, symbol)::INTEGER AS rank FROM quotes"))
def by_abs_change(spark, sf):
    x = quotes(spark, sf).withColumn("mag", F.abs("change_pct"))
    return screen.rank_by_score(x, "mag").select("symbol", "change_pct", "rank")


@query(
    "top02_quick_rank",
    recursive(FEATURE_SQL + f" SELECT symbol, day, round(close, 2) AS price, score, vol_signal, vol_score, trunc(score * 0.6::DOUBLE + vol_score * 0.2::DOUBLE + 50 * 0.2::DOUBLE)::INTEGER AS final_score FROM (SELECT *, {SCORE_SQL} AS score, {VOL_SIGNAL_SQL} AS vol_signal, {VOL_SCORE_SQL} AS vol_score FROM feats) ORDER BY 7 DESC, symbol LIMIT 15"),
)
def quick_rank(spark, sf):
    return screen.quick_rank(spark, sf)


@query("top03_report_tops")
def report_tops(spark, sf):
    """In-zone buys of the main market by score, and the first buys and sells of the second market."""
    x = screen.full_scan(spark, sf).filter(F.col("is_buy") & (F.col("position") == L.INSIDE)).orderBy(F.desc("score"), "symbol").limit(10)
    main = x.select(F.lit("in_zone").alias("bucket"), F.row_number().over(Window.orderBy(F.desc("score"), "symbol")).alias("rn"), "symbol", "score", "signal")
    second = screen.second_tops(screen.second_scan(spark, sf))
    return main.unionByName(second.select(F.concat(F.lit("second_"), F.col("side")).alias("bucket"), "rn", "symbol", "score", "signal"))


@query("top03_second_market")
def second_scan(spark, sf):
    return screen.second_scan(spark, sf)


@query("top05_by_momentum", with_bars(MOMENTUM_SQL + " SELECT symbol, momentum, rank FROM (SELECT symbol, round(r20 * 0.15 + r60 * 0.35 + r120 * 0.5, 6) + 0.0 AS momentum, row_number() OVER (ORDER BY r20 * 0.15 + r60 * 0.35 + r120 * 0.5 DESC, symbol)::INTEGER AS rank FROM (SELECT *, max(idx) OVER (PARTITION BY symbol) AS n FROM mo) WHERE idx = n) WHERE rank <= 5"))
def by_momentum(spark, sf):
    x = screen.last_bar(T.walk_bars(spark, sf).withColumns(ind.momentum(SERIES)))
    top = x.orderBy(F.desc("momentum"), "symbol").limit(5)
    return top.select("symbol", r("momentum", 6), F.row_number().over(Window.orderBy(F.desc("momentum"), "symbol")).alias("rank"))


@query("top07_boards", "WITH " + BOARD_SQL + " SELECT name, chg + 0.0 AS chg, value FROM boards ORDER BY value DESC, name LIMIT 5")
def top_boards(spark, sf):
    return board_rows(spark, sf).orderBy(F.desc("value"), "name").limit(5).select("name", "chg", "value")


@query("set01_union_boards", "WITH " + BOARD_SQL + " SELECT kind, name, up FROM boards")
def union_boards(spark, sf):
    return board_rows(spark, sf).select("kind", "name", "up")


def book(spark, sf):
    c = T.load(spark, sf, "customer")
    k = F.col("c_custkey")
    stored = c.filter(k % 3 != 0).select(k.alias("code"), F.col("c_name").alias("name"), (50 + k % 50).cast("double").alias("cost"), (k % 9).alias("qty"))
    changes = c.filter(k % 2 == 0).select(k.alias("code"), F.col("c_name").alias("name"), (k % 4 * 20).cast("double").alias("cost"), (k % 5 - 1).alias("qty"))
    return stored, changes


BOOK = """WITH st AS (SELECT c_custkey AS code, c_name AS name, (50 + c_custkey % 50)::DOUBLE AS cost, c_custkey % 9 AS qty FROM customer WHERE c_custkey % 3 <> 0),
ch AS (SELECT c_custkey AS code, c_name AS name, (c_custkey % 4 * 20)::DOUBLE AS cost, c_custkey % 5 - 1 AS qty FROM customer WHERE c_custkey % 2 = 0)
"""


@query("set06_pf01_upsert", BOOK + " SELECT coalesce(st.code, ch.code) AS code, coalesce(st.name, ch.name) AS name, CASE WHEN coalesce(ch.cost, 0) > 0 THEN ch.cost ELSE coalesce(st.cost, ch.cost, 0) END AS cost, CASE WHEN coalesce(ch.qty, 0) > 0 THEN ch.qty ELSE coalesce(st.qty, ch.qty, 0) END AS qty FROM st FULL JOIN ch ON st.code = ch.code")
def upsert(spark, sf):
    return PF.upsert(*book(spark, sf))


@query("pf01_remove", BOOK + " SELECT code, name, cost, qty FROM st WHERE code NOT IN (SELECT code FROM ch)")
def remove(spark, sf):
    return PF.remove(*book(spark, sf))


VALUED = POSITIONS + """, val AS (SELECT c_custkey, p.symbol, p.cost, p.qty, coalesce(price, 0) AS price, round(CASE WHEN cost > 0 THEN (coalesce(price, 0) - cost) / cost * 100 ELSE 0 END, 2) + 0.0 AS pnl_pct,
  coalesce(price, 0) * qty * 100 AS value, (coalesce(price, 0) - coalesce(cost, 0)) * qty * 100 AS pnl FROM positions p LEFT JOIN quotes q USING (symbol))
"""


def valued(spark, sf):
    b = T.walk_bars(spark, sf)
    return PF.valued(T.positions(spark, sf, b), T.quotes(b))


@query("pf02_mark_to_market", Q(" SELECT c_custkey, symbol, pnl_pct, value, pnl FROM val", VALUED))
def mark_to_market(spark, sf):
    return valued(spark, sf).select("c_custkey", "symbol", r("pnl_pct", 2), "value", "pnl")


@query("pf03_alerts", Q(" SELECT c_custkey, concat_ws(';', CASE WHEN pnl_pct * 10 >= 15 THEN 'take_profit' END, CASE WHEN pnl_pct * 10 <= -8 THEN 'stop_loss' END) AS alerts FROM val", VALUED))
def alerts(spark, sf):
    x = valued(spark, sf).withColumn("pnl_pct", F.col("pnl_pct") * 10)
    return x.select("c_custkey", F.array_join(PF.alerts(), ";").alias("alerts"))


@query(
    "pf03_declared_alerts",
    with_bars(f""", x AS (SELECT symbol, day, (close / {lag('close')} - 1) * 100 AS chg, volume / avg(volume) {back(5)} AS vr, (max(close) OVER w - close) / max(close) OVER w * 100 AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING))
    SELECT symbol, day, concat_ws(';', CASE WHEN abs(chg) >= 5 THEN 'day_move' END, CASE WHEN vr > 2 THEN 'volume_surge' END, CASE WHEN dd >= 5 THEN 'trailing_drawdown' END) AS alerts FROM x"""),
)
def declared_alerts(spark, sf):
    b = T.walk_bars(spark, sf).withColumns({"chg": (F.col("close") / ind.prev(SERIES, "close", 1) - 1) * 100, "vr": ind.volume_price(SERIES)["vol_ratio"], "dd": PF.trailing_drawdown(["symbol"], "close", "idx")})
    return b.select("symbol", "day", F.array_join(PF.declared_alerts("chg", "vr", "dd"), ";").alias("alerts"))


@query("agg09_portfolio_totals", Q(" SELECT sum(value) AS total_value, sum(pnl) AS total_pnl FROM val", VALUED))
def portfolio_totals(spark, sf):
    return PF.totals(valued(spark, sf))


ALLOC = MOMENTUM_SQL + """, lastm AS (SELECT symbol, close / 1000 AS price, r20 * 0.15 + r60 * 0.35 + r120 * 0.5 AS momentum, idx >= 129 AND close > ma120 AND r120 > 0 AS gate FROM (SELECT *, max(idx) OVER (PARTITION BY symbol) AS n FROM mo) WHERE idx = n),
al AS (SELECT symbol, price, floor(200000 * 0.8 / 5 / (price * 100))::BIGINT AS lots FROM (SELECT * FROM lastm WHERE gate ORDER BY momentum DESC, symbol LIMIT 5))
"""


def picks(spark, sf):
    b = T.walk_bars(spark, sf).withColumns({**ind.momentum(SERIES), "gate": ind.uptrend(SERIES)})
    x = screen.last_bar(b).filter("gate").withColumn("price", F.col("close") / 1000)
    return PF.allocate(x)


@query("pf04_allocation", with_bars(ALLOC + " SELECT symbol, round(price, 3) AS price, lots, round(lots * 100 * price, 2) AS cost FROM al"))
def allocation(spark, sf):
    return picks(spark, sf).select("symbol", r("price", 3), F.col("lots").cast("bigint").alias("lots"), r("cost", 2))


@query("agg10_allocation_totals", with_bars(ALLOC + " SELECT round(sum(lots * 100 * price), 2) AS invested, round(200000 - sum(lots * 100 * price), 2) AS cash, round(sum(lots * 100 * price) / 200000 * 100, 4) AS deployed_pct FROM al"))
def allocation_totals(spark, sf):
    t = PF.allocation_totals(picks(spark, sf))
    return t.select(r("invested", 2), r("cash", 2), r("deployed_pct", 4))


@query("pf05_deployment", "WITH " + MACRO + " SELECT day, CASE WHEN close < 25 THEN 80.0 ELSE 15.0 END::DOUBLE AS deploy_pct FROM ms WHERE name = 'VIX'")
def deployment(spark, sf):
    v = C.macro_series(spark, sf).filter("name = 'VIX'")
    return v.select("day", PF.deployment(F.col("close"), 80.0, 15.0).alias("deploy_pct"))


# ---- sectors, short interest, warrants ------------------------------------------------------------------------


@query(
    "mkt01_sector_signal",
    Q(f""", x AS (SELECT u.symbol, u.sector, h.*EXCLUDE (sector), coalesce(up, 0) / greatest(coalesce(up, 0) + coalesce(dn, 0), 1) * 100 AS ratio FROM universe u LEFT JOIN (SELECT * FROM heat WHERE sector NOT LIKE '%5') h USING (sector))
    SELECT symbol, sector, CASE WHEN chg IS NULL THEN '{L.SECTOR_NONE}' WHEN chg > 2 AND ratio > 60 THEN '{L.SECTOR_LEAD}' WHEN chg > 0 THEN '{L.SECTOR_STRONG}' WHEN chg > -2 THEN '{L.SECTOR_FLAT}' ELSE '{L.SECTOR_WEAK}' END AS sector_signal,
           CASE WHEN chg IS NULL THEN 0 ELSE round(ratio, 4) END AS up_ratio, coalesce(score, 50)::INTEGER AS sector_score FROM x""", UNI, HEAT),
)
def sector_signal(spark, sf):
    h = heat(spark, sf).filter(~F.endswith("sector", F.lit("5")))
    x = T.universe(spark, sf).join(h, "sector", "left").withColumns(C.sector_signal())
    return x.select("symbol", "sector", "sector_signal", r("up_ratio", 4), F.col("sector_score").cast("int").alias("sector_score"))


@query("mkt02_heat_or_inferred", Q(", direct AS (SELECT n_name AS sector, 1.5::DOUBLE AS chg FROM nation WHERE n_nationkey < 9), pick AS (SELECT count(*) > 10 AS big FROM direct) SELECT sector, chg FROM direct, pick WHERE big UNION ALL SELECT sector, chg + 0.0 FROM heat, pick WHERE NOT big", UNI, HEAT))
def heat_or_inferred(spark, sf):
    direct = T.load(spark, sf, "nation").filter("n_nationkey < 9").select(F.col("n_name").alias("sector"), F.lit(1.5).alias("chg"))
    return C.heat_or_inferred(direct, heat(spark, sf)).select("sector", r("chg", 2))


@query("hk01_short_tier", with_bars(SHORT_SQL + f", t AS (SELECT symbol, day, ratio, avg(ratio) {back(3)} AS m3, avg(ratio) {back(5)} AS m5 FROM si) SELECT symbol, day, CASE WHEN ratio < 10 THEN 'low' WHEN ratio <= 20 THEN 'mid' ELSE 'high' END AS tier, CASE WHEN round(m3, 6) < round(m5, 6) THEN 'covering' WHEN round(m3, 6) > round(m5, 6) THEN 'building' ELSE 'flat' END AS trend FROM t"))
def hk_short_tier(spark, sf):
    s = C.short_ratios(spark, sf)
    m = lambda k: F.round(F.avg("short_ratio").over(SERIES.back(k)), 6)
    return s.select("symbol", "day", C.short_tier(F.col("short_ratio")).alias("tier"), C.short_trend(m(3), m(5)).alias("trend"))


# the last close in units of the warrants' strikes
SPOT = """, spot AS (SELECT symbol, arg_max(close, idx) / 32.0 AS spot FROM bars GROUP BY symbol),
war AS (SELECT l_suppkey::VARCHAR AS symbol, CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS kind, round(l_extendedprice / l_quantity, 2) AS strike, l_extendedprice AS turnover, l_quantity AS outstanding FROM lineitem)
"""


def spot(spark, sf):
    return T.walk_bars(spark, sf).groupBy("symbol").agg((F.max_by("close", "idx") / 32.0).alias("spot"))


WSTAT = SPOT + """, ws AS (SELECT symbol, round(min(CASE WHEN kind = 'call' AND strike >= spot THEN (strike - spot) / spot * 100 END), 4) AS near_call_dist, round(sum(CASE WHEN kind = 'call' THEN turnover ELSE 0 END), 2) AS call_turnover, round(sum(CASE WHEN kind = 'put' THEN turnover ELSE 0 END), 2) AS put_turnover,
  round(sum(CASE WHEN kind = 'put' THEN turnover ELSE 0 END) / sum(CASE WHEN kind = 'call' THEN turnover ELSE 0 END), 4) AS put_call FROM war JOIN spot USING (symbol) GROUP BY symbol),
cs AS (SELECT symbol, arg_max(strike, row(outstanding, -strike)) FILTER (kind = 'call' AND strike < spot) AS bull_recall, arg_max(strike, row(outstanding, -strike)) FILTER (kind = 'put' AND strike > spot) AS bear_recall, any_value(spot) AS spot FROM war JOIN spot USING (symbol) GROUP BY symbol),
cd AS (SELECT *, (bull_recall - spot) / spot * 100 AS bd FROM cs)
"""


@query("hk02_warrants", with_bars(WSTAT + " SELECT symbol, near_call_dist, call_turnover, put_turnover, put_call FROM ws"))
def hk_warrants(spark, sf):
    w = C.warrant_stats(C.warrants(spark, sf), spot(spark, sf))
    return w.select("symbol", r("near_call_dist", 4), r("call_turnover", 2), r("put_turnover", 2), r("put_call", 4))


@query("hk03_callables", with_bars(WSTAT + " SELECT symbol, bull_recall, bear_recall, round(bd, 4) + 0.0 AS bull_dist, round((bear_recall - bull_recall) / spot * 100, 4) + 0.0 AS gap_pct, CASE WHEN abs(bd) < 3 THEN 'danger' WHEN abs(bd) <= 8 THEN 'watch' ELSE 'safe' END AS bull_class FROM cd"))
def hk_callables(spark, sf):
    c = C.callable_stats(C.warrants(spark, sf), spot(spark, sf))
    return c.select("symbol", "bull_recall", "bear_recall", r("bull_dist", 4), r("gap_pct", 4), "bull_class")


COMPOSITE = SHORT_SQL + WSTAT + """, sl AS (SELECT symbol, arg_max(ratio, idx) AS ratio FROM si GROUP BY symbol),
fl AS (SELECT symbol, CASE WHEN ratio < 10 THEN 1 ELSE 0 END + CASE WHEN call_turnover > 0 AND near_call_dist < 15 THEN 1 ELSE 0 END + CASE WHEN (bear_recall - bull_recall) / spot * 100 < 25 THEN 1 ELSE 0 END AS flags FROM sl JOIN ws USING (symbol) JOIN cd USING (symbol))
"""


@query("hk04_composite", with_bars(COMPOSITE + " SELECT symbol, flags, row_number() OVER (ORDER BY flags DESC, symbol)::INTEGER AS rank FROM fl"))
def hk_composite(spark, sf):
    s = C.short_ratios(spark, sf).groupBy("symbol").agg(F.max_by("short_ratio", "idx").alias("ratio"))
    wa, sp = C.warrants(spark, sf), spot(spark, sf)
    x = s.join(C.warrant_stats(wa, sp), "symbol").join(C.callable_stats(wa, sp), "symbol")
    flags = F.when(F.col("ratio") < 10, 1).otherwise(0) + F.when((F.col("call_turnover") > 0) & (F.col("near_call_dist") < 15), 1).otherwise(0) + F.when(F.col("gap_pct") < 25, 1).otherwise(0)
    return screen.rank_by_score(x.withColumn("flags", flags), "flags").select("symbol", "flags", "rank")


@query("hk05_rebound_shorting", with_bars(SHORT_SQL + f", j AS (SELECT b.symbol, b.day, b.close / lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.idx) - 1 AS ret, s.ratio - lag(s.ratio) OVER (PARTITION BY b.symbol ORDER BY b.idx) AS jump FROM bars b JOIN si s ON s.symbol = b.symbol AND s.day = b.day) SELECT symbol, day, CASE WHEN ret > 0 AND jump > 5 THEN 'adding' WHEN ret > 0 AND jump < 0 AND jump > -5 THEN 'slight_cover' ELSE 'none' END AS behaviour FROM j"))
def hk_rebound(spark, sf):
    b = T.walk_bars(spark, sf).select("symbol", "day", "close", "idx").join(C.short_ratios(spark, sf).select("symbol", "day", "short_ratio"), ["symbol", "day"])
    w = SERIES.w()
    ret, jump = F.col("close") / F.lag("close").over(w) - 1, F.col("short_ratio") - F.lag("short_ratio").over(w)
    x = b.withColumns({"ret": ret, "jump": jump})
    return x.select("symbol", "day", F.when((F.col("ret") > 0) & (F.col("jump") > 5), "adding").when((F.col("ret") > 0) & (F.col("jump") < 0) & (F.col("jump") > -5), "slight_cover").otherwise("none").alias("behaviour"))


# ---- whole scans and report tables ----------------------------------------------------------------------------


@query("snk01_ranked_scan")
def ranked_scan(spark, sf):
    return screen.ranked(screen.full_scan(spark, sf))


@query("snk02_report")
def report(spark, sf):
    from barflow.plans.report import build

    return build(spark, sf)


@query("snk06_board_export", "WITH " + BOARD_SQL + " SELECT name, up, dn FROM boards")
def board_export(spark, sf):
    return board_rows(spark, sf).select("name", "up", "dn")


@query("snk07_trade_plan")
def trade_plan(spark, sf):
    from barflow.plans.report import trade_plan as plan

    return plan(spark, sf)


@query("snk07_plan_sections")
def plan_sections(spark, sf):
    from barflow.plans.report import plan_sections as sections

    return sections(spark, sf)


def live_quotes(spark, sf):
    """Live prices: two of three symbols moved away from their last close, by up to 3 % either way."""
    q, k = T.quotes(T.walk_bars(spark, sf)), F.col("symbol").cast("int")
    return q.filter(k % 3 != 0).select("symbol", F.round(F.col("price") * (1 + (k % 7 - 3) / 100), 2).alias("price"))


@query("snk08_live_buys")
def live_buys(spark, sf):
    from barflow.plans.report import live_buy_list

    return live_buy_list(spark, sf, live_quotes(spark, sf))


@query("mac05_futures_products")
def futures_products(spark, sf):
    """The screen on a futures universe: structure, score and trend per product (the hourly event series)."""
    from barflow.plans.report import products

    return products(spark, sf)
