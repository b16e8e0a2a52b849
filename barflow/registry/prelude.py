"""SQL of the derived views, shared by the oracle queries."""

TICKS = """
ticks AS (
  SELECT l_suppkey::VARCHAR AS symbol, l_shipdate::DATE AS day, l_orderkey AS ok, l_linenumber AS ln,
         l_partkey AS pk, l_extendedprice AS px, l_quantity AS qty, l_returnflag AS flag,
         round(l_extendedprice * 100)::BIGINT % 401 - 200 AS step,
         round(l_tax * 1000)::BIGINT AS up, round(l_discount * 1000)::BIGINT AS dn
  FROM lineitem)
"""

BARS = (
    TICKS
    + """,
walked AS (
  SELECT *, 100000 + sum(step) OVER (PARTITION BY symbol ORDER BY day, ok, ln, pk, px
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS post
  FROM ticks),
bars AS (
  SELECT symbol, day, (row_number() OVER (PARTITION BY symbol ORDER BY day) - 1)::INTEGER AS idx,
         open, high, low, close, volume, turnover
  FROM (
    SELECT symbol, day,
           arg_min(post - step, row(ok, ln, pk, px))::DOUBLE AS open,
           max(greatest(post, post - step) + up)::DOUBLE AS high,
           min(least(post, post - step) - dn)::DOUBLE AS low,
           arg_max(post, row(ok, ln, pk, px))::DOUBLE AS close,
           sum(qty) AS volume, sum(px) AS turnover
    FROM walked GROUP BY symbol, day))
"""
)

PRICE_BARS = (
    TICKS
    + """,
pbars AS (
  SELECT symbol, day,
         arg_min(round(px / qty * 100)::BIGINT, row(ok, ln, pk, px)) AS open,
         max(round(px / qty * 100)::BIGINT) AS high, min(round(px / qty * 100)::BIGINT) AS low,
         arg_max(round(px / qty * 100)::BIGINT, row(ok, ln, pk, px)) AS close,
         sum(qty) AS volume, sum(px) AS turnover
  FROM ticks GROUP BY symbol, day)
"""
)

HOURS = """
hbars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)
"""

QUOTES = """,
quotes AS (
  SELECT symbol, day, close AS price, open, volume,
         round(coalesce((close / prev_close - 1) * 100, 0), 4) AS change_pct
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS prev_close,
               max(idx) OVER (PARTITION BY symbol) AS last_idx FROM bars)
  WHERE idx = last_idx)
"""

UNIVERSE = """
universe AS (
  SELECT s_suppkey::VARCHAR AS symbol, s_name AS name, coalesce(n_name, 'other') AS sector,
         coalesce(r_name, 'other') AS parent
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
"""

THEMES = """
themes AS (
  SELECT symbol, string_agg(p_brand, '|' ORDER BY p_brand) AS themes FROM (
    SELECT DISTINCT symbol, p_brand FROM (
      SELECT symbol, p_brand, row_number() OVER (PARTITION BY symbol ORDER BY c DESC, p_brand, p_partkey) AS rn
      FROM (SELECT l_suppkey::VARCHAR AS symbol, l_partkey, count(*) AS c FROM lineitem GROUP BY 1, 2)
           JOIN part ON l_partkey = p_partkey)
    WHERE rn <= 5)
  GROUP BY symbol)
"""

FUNDAMENTALS = """
fundamentals AS (
  SELECT p_partkey AS code, p_name AS name, (5 + p_size)::DOUBLE AS pe, p_size / 10.0::DOUBLE AS pb,
         (p_partkey % 35)::DOUBLE AS roe, (p_partkey % 70)::DOUBLE AS gross_margin,
         (p_partkey * 7 % 90)::DOUBLE AS debt_ratio, (p_partkey * 13 % 50 - 10)::DOUBLE AS revenue_growth,
         (p_size % 6)::DOUBLE AS dividend_yield, p_retailprice AS market_cap, (p_partkey % 3 - 1)::DOUBLE AS fcf,
         (p_partkey % 11)::DOUBLE AS cash, (p_partkey % 7)::DOUBLE AS debt, (p_partkey % 5 - 2)::DOUBLE AS operating_cf
  FROM part)
"""

POSITIONS = """,
positions AS (
  SELECT c_custkey, c_name AS name, (c_custkey % (SELECT count(*) FROM supplier))::VARCHAR AS symbol,
         1 + c_custkey % 9 AS qty, cost
  FROM customer LEFT JOIN (
    SELECT symbol AS psym, close AS cost FROM (SELECT *, max(idx) OVER (PARTITION BY symbol) AS n FROM bars)
    WHERE idx = n - 20) ON psym = (c_custkey % (SELECT count(*) FROM supplier))::VARCHAR)
"""


def with_bars(body: str, *more: str) -> str:
    return "WITH " + BARS + "".join(more) + body


def recursive(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + BARS + "".join(more) + body
