"""SRC, PRJ, JOIN-04..06, AGG-01/02 and SET rows over bars and raw vendor rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.registry.core import query, r
from barflow.registry.prelude import BARS, HOURS, PRICE_BARS, QUOTES, THEMES, UNIVERSE, with_bars
from barflow.sources import tables as T
from barflow.sources import vendors as V


def P(body: str) -> str:
    return "WITH " + PRICE_BARS + body


# ---- sources --------------------------------------------------------------------------------------------------


@query(
    "src01_csv_bars",
    P(" SELECT symbol, day::TIMESTAMP AS ts, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume FROM pbars WHERE day >= DATE '1998-01-01' AND day <= DATE '1999-12-31'"),
)
def csv_bars(spark, sf):
    b = T.price_bars(spark, sf)
    lines = b.select("symbol", F.concat_ws(",", F.date_format("day", "yyyy-MM-dd"), "open", "high", "low", "close", "volume").alias("value"))
    return V.csv_lines(lines, "1998-01-01", "1999-12-31").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


@query(
    "src02_parse_time",
    "SELECT event_id, date_trunc('day', ts) AS t10, date_trunc('second', ts) AS t17, date_trunc('second', ts) AS t19, NULL::TIMESTAMP AS bad FROM events",
)
def parse_time(spark, sf):
    e = T.load(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    x = e.select(
        "event_id", F.date_format("t", "yyyy-MM-dd").alias("a"), F.date_format("t", "yyyyMMddHHmmssSSS").alias("b"), F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("c"), F.lit("n/a").alias("d"),
    )
    ntz = lambda col: V.parse_time(col).cast("timestamp_ntz")
    return x.select("event_id", ntz("a").alias("t10"), ntz("b").alias("t17"), ntz("c").alias("t19"), ntz("d").alias("bad"))


@query("src03_json_arrays", P(" SELECT symbol, day, open::DOUBLE AS open, close::DOUBLE AS close, high::DOUBLE AS high, low::DOUBLE AS low, volume FROM pbars"))
def json_arrays(spark, sf):
    b = T.price_bars(spark, sf)
    row = F.array(F.date_format("day", "yyyy-MM-dd"), *[F.col(c).cast("string") for c in ("open", "close", "high", "low", "volume")])
    # one document per (symbol, year), as vendors page them; even years use the adjusted key
    docs = b.groupBy("symbol", F.year("day").alias("y")).agg(F.collect_list(row).alias("rows"))
    key = F.when(F.col("y") % 2 == 0, "qfqday").otherwise("day")
    raw = docs.select("symbol", F.to_json(F.create_map(key, F.col("rows"))).alias("value"))
    return V.json_arrays(raw)


@query("src04_landed_frame", with_bars(" SELECT symbol, day, open, high, low, close, volume FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 540)"))
def landed_frame(spark, sf):
    b = T.walk_bars(spark, sf)
    raw = b.select("symbol", F.col("day").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    return V.landed_frame(raw, 540).select("symbol", "day", "open", "high", "low", "close", "volume")


@query(
    "src05_localised_bars",
    P(" SELECT symbol, day, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, CASE WHEN symbol LIKE '%7' THEN 0 ELSE volume END AS volume, 0.0::DOUBLE AS turnover, symbol LIKE '%0' AS is_index FROM pbars"),
)
def localised(spark, sf):
    b = T.price_bars(spark, sf)
    k = F.dayofmonth("day") % 3
    date = F.when(k == 0, F.date_format("day", "yyyyMMdd")).when(k == 1, F.date_format("day", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" 00:00:00")))
    raw = b.select(
        "symbol", date.alias("日期"), F.col("open").cast("string").alias("开盘"), F.col("close").cast("string").alias("收盘"), F.col("high").cast("string").alias("最高"), F.col("low").cast("string").alias("最低"),
        F.when(F.endswith("symbol", F.lit("7")), "-").otherwise(F.col("volume").cast("string")).alias("成交量"),
    )
    code = F.concat(F.lit("sh"), F.when(F.endswith("symbol", F.lit("0")), F.lit("000")).otherwise(F.lit("600")), F.col("symbol"))
    return V.localised(raw).withColumn("is_index", V.is_index(code)).select("symbol", "day", "open", "high", "low", "close", "volume", "turnover", "is_index")


@query("src06_row_arrays", P(" SELECT symbol, day, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume, round(turnover, 2) AS turnover, 0.0::DOUBLE AS turnover_rate FROM pbars"))
def row_arrays(spark, sf):
    b = T.price_bars(spark, sf)
    row = F.array(F.date_format("day", "yyyy-MM-dd"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")], F.round("turnover", 2).cast("string"), F.lit(""))
    return V.row_arrays(b.select("symbol", row.alias("row")))


@query("src07_epoch_arrays", "WITH " + HOURS + " SELECT symbol, ts, open, high, low, close, volume FROM hbars")
def epoch_arrays(spark, sf):
    b = T.hour_bars(spark, sf)
    raw = b.select("symbol", F.array((F.unix_seconds("ts") * 1000).cast("double"), "open", "high", "low", "close", F.col("volume")).alias("row"))
    return V.epoch_arrays(raw).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


MIN5 = """
m5 AS (SELECT event_type AS symbol, ts::DATE AS day, strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%H%M') AS time,
              arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2, 3)
"""


def minute_bars(spark, sf):
    ev = T.load(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    b = B.resample(ev, "5 minutes")
    return b.select("symbol", F.to_date("ts").alias("day"), F.date_format("ts", "HHmm").alias("time"), "close", "volume")


@query("src08_minute_json", "WITH " + MIN5 + " SELECT symbol, day, time, close, volume FROM m5")
def minute_json(spark, sf):
    item = F.struct(F.date_format("day", "yyyy-MM-dd").alias("day"), "time", F.col("close").cast("string").alias("close"), F.col("volume").cast("string").alias("volume"))
    raw = minute_bars(spark, sf).groupBy("symbol", "day").agg(F.to_json(F.collect_list(item)).alias("value")).select("symbol", "value")
    return V.minute_json(raw)


@query("src09_quote_lines", with_bars(" SELECT symbol, 'n' || symbol AS name, price, change_pct FROM quotes", QUOTES))
def quote_lines(spark, sf):
    q = T.quotes(T.walk_bars(spark, sf))
    fill = lambda n: F.repeat(F.lit("~0"), n)
    line = F.concat(F.lit('v_sz="1~n'), F.col("symbol"), F.lit("~"), F.col("symbol"), F.lit("~"), F.col("price").cast("string"), fill(28), F.lit("~"), F.col("change_pct").cast("string"), fill(10))
    short = F.concat(F.lit("1~x~"), F.col("symbol"), F.lit("~1.0"))
    free = F.concat(F.lit("1~x~"), F.col("symbol"), F.lit("~0.0"), fill(40))
    return V.quote_lines(q.select(F.explode(F.array(line, short, free)).alias("value")))


SOURCES = """, srcs AS (
  SELECT symbol, day, close, 1 AS src_rank FROM bars WHERE idx < symbol::INTEGER
  UNION ALL SELECT symbol, day, close, 2 FROM bars WHERE idx < symbol::INTEGER * 3
  UNION ALL SELECT symbol, day, close, 3 FROM bars)
"""


def sourced(spark, sf):
    b = T.walk_bars(spark, sf)
    n = F.col("symbol").cast("int")
    copies = F.array_compact(F.array(F.when(F.col("idx") < n, 1), F.when(F.col("idx") < n * 3, 2), F.lit(3)))
    return b.select("symbol", "day", "close", F.explode(copies).alias("src_rank"))


@query(
    "src10_source_fallback",
    with_bars(" , ok AS (SELECT symbol, min(src_rank) AS src_rank FROM (SELECT symbol, src_rank FROM srcs GROUP BY 1, 2 HAVING count(*) >= 30) GROUP BY 1) SELECT s.symbol, s.day, s.close, s.src_rank FROM srcs s JOIN ok USING (symbol, src_rank)", SOURCES),
)
def source_fallback(spark, sf):
    return B.first_source(sourced(spark, sf)).select("symbol", "day", "close", "src_rank")


@query("src11_last_250", with_bars(" SELECT symbol, day, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM bars) WHERE k <= 250"))
def last_250(spark, sf):
    return B.last_n(T.walk_bars(spark, sf), 250).select("symbol", "day", "close")


CODES = "SELECT lpad(c_custkey::VARCHAR, 6, substr('0368', 1 + (c_custkey % 4)::INTEGER, 1)) AS code, CASE WHEN c_custkey % 11 = 0 THEN 'ST' || c_name WHEN c_custkey % 13 = 0 THEN c_name || '退' ELSE c_name END AS name, c_acctbal AS price, c_custkey % 5 AS volume FROM customer"
SKIP = "name NOT LIKE '%ST%' AND name NOT LIKE '%退%' AND NOT regexp_matches(code, '^(688|8|4|83|87|200|900|920)')"


def coded(spark, sf):
    k = F.col("c_custkey")
    pad = F.substring(F.lit("0368"), (1 + k % 4).cast("int"), F.lit(1))
    name = F.when(k % 11 == 0, F.concat(F.lit("ST"), F.col("c_name"))).when(k % 13 == 0, F.concat(F.col("c_name"), F.lit("退"))).otherwise(F.col("c_name"))
    return T.load(spark, sf, "customer").select(F.lpad(k.cast("string"), F.lit(6), pad).alias("code"), name.alias("name"), F.col("c_acctbal").alias("price"), (k % 5).alias("volume"), F.round(k % 21 - F.lit(10.0), 1).alias("change_pct"))


@query("src12_main_market", f"WITH c AS ({CODES}) SELECT code, name FROM c WHERE {SKIP}")
def main_market(spark, sf):
    return V.main_market(coded(spark, sf)).select("code", "name")


@query("src13_second_market", "SELECT 'hk' || lpad(s_suppkey::VARCHAR, 5, '0') AS code, s_name AS name FROM supplier")
def second_market(spark, sf):
    s = T.load(spark, sf, "supplier")
    lines = s.select(F.concat(F.lit("hk"), V.padded(F.col("s_suppkey"), 5), F.lit(","), F.col("s_name")).alias("value"))
    return lines.select(F.from_csv("value", F.lit("code string, name string")).alias("r")).select("r.*")


@query("src14_tradable", f"WITH c AS ({CODES}) SELECT code, name, price FROM c WHERE {SKIP} AND volume > 0 AND price > 0")
def tradable(spark, sf):
    return V.tradable(coded(spark, sf)).select("code", "name", "price")


@query("src15_padded_codes", "SELECT lpad(p_partkey::VARCHAR, 6, '0') AS code, p_name AS name FROM part")
def padded(spark, sf):
    return T.load(spark, sf, "part").select(V.padded(F.col("p_partkey")).alias("code"), F.col("p_name").alias("name"))


@query("src16_theme_rows", "WITH " + THEMES + " SELECT symbol, unnest(string_split(themes, '|')) AS theme FROM themes")
def theme_rows(spark, sf):
    return V.exploded_themes(T.themes(spark, sf))


BOARD_SQL = """
boards AS (
  SELECT 'industry' AS kind, n_name AS name, round(avg(c_acctbal) / 1000 - 4, 4) AS chg, count_if(c_acctbal > 0)::INTEGER AS up, count_if(c_acctbal <= 0)::INTEGER AS dn, round(sum(c_acctbal), 2) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
  UNION ALL
  SELECT 'concept', c_mktsegment, round(avg(c_acctbal) / 1000 - 4, 4), count_if(c_acctbal > 0)::INTEGER, count_if(c_acctbal <= 0)::INTEGER, round(sum(c_acctbal), 2) FROM customer GROUP BY c_mktsegment)
"""


def board_rows(spark, sf):
    cu, na = T.load(spark, sf, "customer"), T.load(spark, sf, "nation")
    aggs = [r(F.avg("c_acctbal") / 1000 - 4, 4, "chg"), F.count_if(F.col("c_acctbal") > 0).cast("int").alias("up"), F.count_if(F.col("c_acctbal") <= 0).cast("int").alias("dn"), F.round(F.sum("c_acctbal"), 2).alias("value")]
    a = cu.join(na, cu.c_nationkey == na.n_nationkey).groupBy(F.col("n_name").alias("name")).agg(*aggs).withColumn("kind", F.lit("industry"))
    b = cu.groupBy(F.col("c_mktsegment").alias("name")).agg(*aggs).withColumn("kind", F.lit("concept"))
    return a.unionByName(b)


@query("src17_board_tables", "WITH " + BOARD_SQL + " SELECT name, chg + 0.0 AS chg, up, dn, value FROM boards")
def board_tables(spark, sf):
    x = board_rows(spark, sf)
    raw = x.select(F.col("name").alias("﻿板块名称"), F.col("chg").cast("string").alias("涨跌幅"), F.col("up").cast("string").alias("上涨家数"), F.col("dn").cast("string").alias("下跌家数"), F.col("value").cast("decimal(18,2)").cast("string").alias("总市值"))
    return V.boards(raw)


@query("src18_board_flow_json", "WITH " + BOARD_SQL + " SELECT name, chg + 0.0 AS pct, value / 10000 AS net_10k, value / 100000000 AS amount_100m FROM boards")
def board_flow(spark, sf):
    item = F.struct("name", F.col("chg").cast("string").alias("zdf"), F.col("value").cast("decimal(18,2)").cast("string").alias("zljlr"), F.col("value").cast("decimal(18,2)").cast("string").alias("cje"))
    # one document per board, shaped like the vendor's nested answer
    x = board_rows(spark, sf).select("kind", F.array(item).alias("top"))
    plate = F.when(F.col("kind") == "industry", F.struct("top"))
    concept = F.when(F.col("kind") == "concept", F.struct("top"))
    doc = F.struct(F.struct(F.struct(plate.alias("plate"), concept.alias("concept")).alias("fundflow")).alias("data"))
    return V.board_flow_json(x.select(F.to_json(doc).alias("value")))


@query(
    "src19_board_ranking",
    "WITH " + BOARD_SQL + " SELECT kind, rn, name, chg + 0.0 AS change_pct, round(value / 1e8, 6) AS amount_100m, up AS up_count, up + dn AS total FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY chg DESC, name)::INTEGER AS rn FROM boards) WHERE rn <= 10",
)
def board_ranking(spark, sf):
    x = board_rows(spark, sf).withColumnsRenamed({"chg": "change_pct", "value": "amount", "up": "up_count", "dn": "down_count"}).withColumn("main_net_amount", F.col("amount"))
    return V.board_ranking(x).select("kind", "rn", "name", "change_pct", r("amount_100m", 6), "up_count", "total")


@query(
    "src27_pasted_tables",
    with_bars(", sh AS (SELECT symbol, day, round(100.0 * sum(CASE WHEN flag = 'R' THEN qty ELSE 0 END) / sum(qty), 4) AS ratio, sum(qty) AS q FROM ticks GROUP BY 1, 2) SELECT symbol, strftime(day, '%Y-%m-%d') AS day, ratio AS short_ratio, q AS short_shares, 'short_selling' AS kind FROM sh"),
)
def pasted_tables(spark, sf):
    t = T.ticks(spark, sf)
    sh = t.groupBy("symbol", "day").agg(F.round(100.0 * F.sum(F.when(F.col("flag") == "R", F.col("qty")).otherwise(0.0)) / F.sum("qty"), 4).alias("ratio"), F.sum("qty").alias("q"))
    header = "日期\t价格\t升跌\t升跌(%)\t沽空股数\t沽空金额\t成交金额\t占大巿沽空比率\t沽空比率\t3天平均\t5天平均"
    line = F.concat_ws("\t", F.date_format("day", "yyyy-MM-dd"), F.lit("1"), F.lit("0"), F.lit("0"), F.col("q").cast("string"), F.lit("1"), F.lit("1"), F.lit("1"), F.col("ratio").cast("string"), F.lit("1"), F.lit("1"))
    x = sh.select("symbol", F.from_csv(line, F.lit(V.TSV_SCHEMAS["short_selling"]), {"sep": "\t"}).alias("r"))
    return x.select("symbol", "r.day", "r.short_ratio", "r.short_shares", V.table_kind(F.lit(header)).alias("kind"))


# ---- cleaning -------------------------------------------------------------------------------------------------


@query("prj01_autofix", P(" SELECT symbol, day, least(open + 3, high, low, close) AS low, greatest(open + 3, high, low, close) AS high, (low > least(open + 3, high, low, close) OR high < greatest(open + 3, high, low, close)) AS broken FROM pbars"))
def autofix(spark, sf):
    b = T.price_bars(spark, sf).withColumn("open", F.col("open") + 3)
    flag = b.withColumn("broken", (F.col("low") > B.sane_low()) | (F.col("high") < B.sane_high()))
    return B.autofix(flag).select("symbol", "day", F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"), "broken")


@query("prj02_to_float", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, 0.0::DOUBLE AS bad FROM events")
def to_float(spark, sf):
    e = T.load(spark, sf, "events")
    return e.select("event_id", V.to_float(F.get_json_object("props", "$.k")).alias("k"), V.to_float(F.col("event_type")).alias("bad"))


@query("prj03_bar_end", "WITH " + HOURS + " SELECT symbol, day AS ts, day + INTERVAL 23 HOUR + INTERVAL 59 MINUTE AS end_ts FROM (SELECT DISTINCT symbol, date_trunc('day', ts)::TIMESTAMP AS day FROM hbars)")
def bar_end(spark, sf):
    d = B.roll_up(T.hour_bars(spark, sf), "day").withColumn("level", F.lit("day"))
    return d.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), B.bar_end().cast("timestamp_ntz").alias("end_ts"))


@query(
    "prj04_out_of_order",
    "SELECT event_type AS symbol, event_id FROM (SELECT *, max(t) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT *, date_trunc('hour', ts) AS t FROM events)) WHERE t <= m",
)
def out_of_order(spark, sf):
    e = T.load(spark, sf, "events").select(F.col("event_type").alias("symbol"), "event_id", F.date_trunc("hour", "ts").alias("ts"))
    return B.out_of_order(e, "event_id", range_bits=10).select("symbol", "event_id")


@query("prj05_min_history", with_bars(" SELECT symbol, day, close FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 535)"))
def min_history(spark, sf):
    return B.long_enough(T.walk_bars(spark, sf), 535).select("symbol", "day", "close")


@query("prj06_live_close", with_bars(" SELECT symbol, day, CASE WHEN idx = max(idx) OVER (PARTITION BY symbol) AND symbol NOT LIKE '%9' THEN open + 1 ELSE close END AS close FROM bars"))
def live_close(spark, sf):
    b = T.walk_bars(spark, sf)
    q = T.quotes(b).filter(~F.endswith("symbol", F.lit("9"))).withColumn("price", F.col("open") + 1)
    return B.live_close(b, q).select("symbol", "day", "close")


@query("prj07_fresh", with_bars(" SELECT symbol, day, close FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING datediff('day', max(day), (SELECT max(day) FROM bars)) <= 3)"))
def fresh(spark, sf):
    b = T.walk_bars(spark, sf)
    as_of = b.agg(F.max("day").alias("as_of"))
    last = b.groupBy("symbol").agg(F.max("day").alias("last_day")).crossJoin(F.broadcast(as_of)).filter(F.datediff("as_of", "last_day") <= 3)
    return b.join(last, "symbol", "left_semi").select("symbol", "day", "close")


@query(
    "prj08_vendor_symbol",
    f"WITH c AS ({CODES}), d AS (SELECT code, code AS c FROM c UNION ALL SELECT 'hk' || code, code FROM c) "
    "SELECT code, CASE WHEN code LIKE 'hk%' THEN lpad(ltrim(c, '0'), 4, '0') || '.HK' WHEN code LIKE '6%' THEN code || '.SS' ELSE code || '.SZ' END AS suffix, "
    "CASE WHEN code LIKE 'hk%' THEN 'hk.' || c WHEN code LIKE '6%' THEN 'sh.' || code ELSE 'sz.' || code END AS dotted, CASE WHEN code LIKE 'hk%' THEN code WHEN code LIKE '6%' THEN 'sh' || code ELSE 'sz' || code END AS prefix FROM d",
)
def vendor_symbol(spark, sf):
    c = coded(spark, sf).select("code")
    both = c.unionByName(c.select(F.concat(F.lit("hk"), "code").alias("code")))
    return both.select("code", *[V.vendor_symbol(F.col("code"), v).alias(v) for v in ("suffix", "dotted", "prefix")])


@query("prj09_min_score", "SELECT p_partkey AS code, p_partkey * 13 % 101 AS score FROM part WHERE p_partkey * 13 % 101 >= 65")
def min_score(spark, sf):
    return T.load(spark, sf, "part").select(F.col("p_partkey").alias("code"), (F.col("p_partkey") * 13 % 101).alias("score")).filter("score >= 65")


@query("prj11_upcoming", "SELECT o_orderkey, datediff('day', DATE '2000-01-01', o_orderdate::DATE)::INTEGER AS days, CASE datediff('day', DATE '2000-01-01', o_orderdate::DATE) WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE datediff('day', DATE '2000-01-01', o_orderdate::DATE) || 'd' END AS tag FROM orders WHERE o_orderdate::DATE >= DATE '2000-01-01'")
def upcoming(spark, sf):
    from barflow.plans.context import upcoming as up

    o = T.load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return up(o, F.lit("2000-01-01").cast("date")).select("o_orderkey", "days", "tag")


@query("prj12_adjusted_scan", P(" SELECT symbol, day, CASE WHEN symbol LIKE '%1' THEN close ELSE close * 2 END AS close FROM pbars"))
def adjusted(spark, sf):
    """Both adjustment forms sit side by side, as partitions would; the scan picks one per symbol."""
    b = T.price_bars(spark, sf).select("symbol", "day", "close", F.explode(F.array(F.lit("none"), F.lit("forward"))).alias("adjust"))
    b = b.withColumn("close", F.when(F.col("adjust") == "forward", F.col("close") * 2).otherwise(F.col("close")))
    want = F.when(F.endswith("symbol", F.lit("1")), "none").otherwise("forward")
    return b.filter(F.col("adjust") == want).select("symbol", "day", F.col("close").cast("bigint").alias("close"))


# ---- bars and levels ------------------------------------------------------------------------------------------


@query("agg01_ticks_to_bars", P(" SELECT symbol, day, open, high, low, close, volume, round(turnover, 2) AS turnover FROM pbars"))
def ticks_to_bars(spark, sf):
    return T.price_bars(spark, sf).select("symbol", "day", "open", "high", "low", "close", "volume", r("turnover", 2))


@query("agg01_walk_bars", with_bars(" SELECT symbol, day, idx, open, high, low, close, volume FROM bars"))
def walk_bars(spark, sf):
    return T.walk_bars(spark, sf, order_range_bits=8).select("symbol", "day", "idx", "open", "high", "low", "close", "volume")


@query("agg01_hour_bars", "WITH " + HOURS + " SELECT symbol, ts, open, high, low, close, volume FROM hbars")
def hour_bars(spark, sf):
    return T.hour_bars(spark, sf).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


@query("agg01_week_bars", with_bars(" SELECT symbol, date_trunc('week', day)::DATE AS week, arg_min(open, day) AS open, max(high) AS high, min(low) AS low, arg_max(close, day) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2"))
def week_bars(spark, sf):
    return B.roll_up(T.walk_bars(spark, sf), "week", ts="day").select("symbol", F.to_date("ts").alias("week"), "open", "high", "low", "close", "volume")


@query(
    "agg02_month_returns",
    with_bars(
        """, m AS (SELECT symbol, date_trunc('month', day)::DATE AS month, arg_min(close, day) AS o, arg_max(close, day) AS c FROM bars GROUP BY 1, 2),
        s AS (SELECT *, c / o - 1 AS ret, lag(c / o - 1, 1) OVER w AS r1, lag(c / o - 1, 2) OVER w AS r2 FROM m WINDOW w AS (PARTITION BY symbol ORDER BY month))
        SELECT symbol, month, round(ret * 100, 4) + 0.0 AS ret_pct, round((ret * 0.15::DOUBLE + r1 * 0.35::DOUBLE + r2 * 0.5::DOUBLE) * 100, 4) + 0.0 AS score FROM s"""
    ),
)
def month_returns(spark, sf):
    b = T.walk_bars(spark, sf)
    m = b.groupBy("symbol", F.to_date(F.date_trunc("month", "day")).alias("month")).agg((F.max_by("close", "day") / F.min_by("close", "day") - 1).alias("ret"))
    w = Window.partitionBy("symbol").orderBy("month")
    score = F.col("ret") * 0.15 + F.lag("ret", 1).over(w) * 0.35 + F.lag("ret", 2).over(w) * 0.5
    return m.select("symbol", "month", r(F.col("ret") * 100, 4, "ret_pct"), r(score * 100, 4, "score"))


LEVELS_SQL = HOURS + """, parents AS (SELECT DISTINCT symbol, date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('day', ts)::TIMESTAMP + INTERVAL 23 HOUR + INTERVAL 59 MINUTE AS end_ts FROM hbars WHERE day(ts) % 7 <> 3),
kids AS (SELECT symbol, ts, ts + INTERVAL 1 HOUR AS end_ts FROM hbars WHERE day(ts + INTERVAL 1 HOUR) <> 12)
"""


def levels(spark, sf):
    h = T.hour_bars(spark, sf)
    day = F.dayofmonth("ts")
    parents = B.roll_up(h.filter(day % 7 != 3), "day").withColumn("level", F.lit("day")).withColumn("end_ts", B.bar_end())
    kids = h.withColumn("end_ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")).filter(F.dayofmonth("end_ts") != 12)
    return parents, kids


@query("join04_children", "WITH " + LEVELS_SQL + " SELECT k.symbol, k.ts, min(p.end_ts) AS parent_end FROM kids k LEFT JOIN parents p ON p.symbol = k.symbol AND p.end_ts >= k.end_ts GROUP BY 1, 2")
def children(spark, sf):
    p, k = levels(spark, sf)
    return B.children(p, k).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("parent_end").cast("timestamp_ntz").alias("parent_end"))


CHILD_SQL = LEVELS_SQL + ", fam AS (SELECT k.symbol, k.ts, k.end_ts, min(p.end_ts) AS parent_end FROM kids k JOIN parents p ON p.symbol = k.symbol AND p.end_ts >= k.end_ts GROUP BY 1, 2, 3)"


@query("join05_childless_parents", "WITH " + CHILD_SQL + " SELECT symbol, end_ts, count(*) OVER (PARTITION BY symbol) >= 2 AS fails FROM parents p WHERE NOT EXISTS (SELECT 1 FROM fam f WHERE f.symbol = p.symbol AND f.parent_end = p.end_ts)")
def childless(spark, sf):
    p, k = levels(spark, sf)
    fam = B.children(p, k)
    alone = p.join(fam.select("symbol", F.col("parent_end").alias("end_ts")), ["symbol", "end_ts"], "left_anti")
    bad = alone.groupBy("symbol").count().select("symbol", (F.col("count") >= 2).alias("fails"))
    return alone.join(bad, "symbol").select("symbol", F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "fails")


@query("join06_day_mismatch", "WITH " + CHILD_SQL + " SELECT symbol, count(*) AS mismatches, count(DISTINCT parent_end) >= 5 AS fails FROM fam WHERE end_ts::DATE <> parent_end::DATE GROUP BY 1")
def day_mismatch(spark, sf):
    p, k = levels(spark, sf)
    fam = B.children(p, k).filter(F.to_date("end_ts") != F.to_date("parent_end"))
    return fam.groupBy("symbol").agg(F.count("*").alias("mismatches"), (F.count_distinct("parent_end") >= 5).alias("fails"))


@query("set05_except_parents", "WITH " + CHILD_SQL + " SELECT symbol, end_ts FROM parents EXCEPT SELECT symbol, parent_end FROM fam")
def except_parents(spark, sf):
    p, k = levels(spark, sf)
    fam = B.children(p, k).select("symbol", "parent_end")
    return p.select("symbol", "end_ts").subtract(fam).select("symbol", F.col("end_ts").cast("timestamp_ntz").alias("end_ts"))
