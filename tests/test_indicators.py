import functools
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barflow.operators import indicators as ind
from barflow.operators.scan import SERIES, Recur, arranged, blocked, numbered, recur, recur_in_order, settle
from tests.conftest import series


def ema(xs, a, seed):
    out = [seed]
    for x in xs[1:]:
        out.append(a * x + (1 - a) * out[-1])
    return out


def walk(n, seed=3):
    r = random.Random(seed)
    x, out = 100.0, []
    for _ in range(n):
        x += r.uniform(-2, 2)
        out.append(round(x, 3))
    return out


@pytest.mark.parametrize("n", [1, 29, 30, 128, 1024, 1025, 5000])
def test_recurrence_equals_a_loop(spark, n):
    xs = walk(n)
    df = recur(series(spark, xs), SERIES, [Recur("y", F.col("close"), 2 / 13, F.col("close")), Recur("z", F.col("close"), 1 / 3, F.lit(50.0), at=5)])
    got = df.orderBy("idx").select("y", "z").collect()
    want = ema(xs, 2 / 13, xs[0])
    assert all(math.isclose(g.y, w, rel_tol=1e-12) for g, w in zip(got, want))
    late = ema(xs[5:], 1 / 3, 50.0) if n > 5 else []
    assert all(g.z is None for g in got[:5])
    assert all(math.isclose(g.z, w, rel_tol=1e-12) for g, w in zip(got[5:], late))


@pytest.mark.parametrize("a", [0.0, 1e-9, 1e-3, 0.03, 1 / 3, 0.6, 0.97, 1 - 1e-12, 1.0])
def test_recurrence_of_any_weight(spark, a):
    xs = walk(4200)
    plan = recur(series(spark, xs), SERIES, [Recur("y", F.col("close"), a, F.col("close"))])
    got = [r.y for r in plan.orderBy("idx").select("y").collect()]
    assert all(math.isclose(g, w, rel_tol=1e-11) for g, w in zip(got, ema(xs, a, xs[0]), strict=True))
    assert "collect_list" not in plan._jdf.queryExecution().toString()


def test_recurrence_forgets_a_huge_start(spark):
    """A first value 20 orders above the rest is still there where the rest is zero, two stretches later."""
    xs = [1e20] + [0.0] * 2200
    got = [r.y for r in recur(series(spark, xs), SERIES, [Recur("y", F.col("close"), 0.05, F.col("close"))]).orderBy("idx").select("y").collect()]
    assert all(math.isclose(g, w, rel_tol=1e-11) for g, w in zip(got, ema(xs, 0.05, xs[0]), strict=True))


def test_blocks_give_the_same_values_as_whole_series(bars):
    whole = ind.kdj(ind.macd(bars)).select("symbol", "idx", "macd", "kdj_d", ind.sma(SERIES, 60).alias("ma"))
    cut, axis = blocked(bars, rows=150, halo=600)
    parts = settle(ind.kdj(ind.macd(cut, axis), axis).withColumn("ma", ind.sma(axis, 60))).select("symbol", "idx", F.col("macd").alias("m2"), F.col("kdj_d").alias("k2"), F.col("ma").alias("ma2"))
    x = whole.join(parts, ["symbol", "idx"])
    assert x.count() == whole.count()
    worst = x.agg(F.max(F.abs(F.col("macd") - F.col("m2"))), F.max(F.abs(F.col("kdj_d") - F.col("k2"))), F.max(F.abs(F.col("ma") - F.col("ma2")))).first()
    assert max(worst) < 1e-7


def test_wilder_rsi(spark):
    xs = walk(60)
    got = [r.rsi_w for r in ind.rsi_wilder(series(spark, xs)).orderBy("idx").collect()]
    ups, downs, want = [], [], [50.0]
    u = d = 0.0
    for k in range(1, len(xs)):
        move = xs[k] - xs[k - 1]
        ups.append(max(move, 0)), downs.append(max(-move, 0))
        if k < 14:
            u, d = sum(ups) / k, sum(downs) / k
        else:
            u, d = (u * 13 + ups[-1]) / 14, (d * 13 + downs[-1]) / 14
        want.append(100 - 100 / (1 + u / d) if d else (100.0 if u else 0.0))
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, want))


def test_constant_prices(spark):
    df = ind.price_features(series(spark, [100.0] * 40, spread=0.0))
    last = df.filter("idx = 39").first()
    assert last.rsi == 50.0 and last.boll_pct_b == 50.0 and last.adx == 0.0 and last.macd_cross == 0.0
    flat = ind.kdj(series(spark, [100.0] * 3, spread=0.0)).filter("idx = 0").first()
    assert math.isclose(flat.kdj_k, 100 / 3)
    assert ind.rsi_wilder(series(spark, [5.0] * 3)).filter("idx = 2").first().rsi_w == 0.0


@pytest.mark.parametrize("delta, vt", [(1e-4, 1e-3), (1e-8, 1e-3), (1e3, 1e-6), (1.0, 1.0), (5.0, 0.0), (0.0, 1e-3), (1e-3, 50.0), (1e6, 1e-9), (0.02, 1e-4)])
def test_filter_for_any_variances(spark, delta, vt):
    xs = walk(700)
    x, p, v = xs[0], 1.0, 0.01
    want = [(x, v)]
    for price in xs[1:]:
        g = (p + vt) / (p + vt + delta)
        v = 0.94 * v + 0.06 * (price - x) ** 2
        x, p = x + g * (price - x), (1 - g) * (p + vt)
        want.append((x, v))
    got = ind.filtered_price(series(spark, xs), delta=delta, vt=vt).orderBy("idx").collect()
    assert len(got) == 700
    assert all(math.isclose(r.kf_price, w[0], rel_tol=1e-9) and math.isclose(r.kf_vol, math.sqrt(w[1]), rel_tol=1e-6, abs_tol=1e-7) for r, w in zip(got, want))


def test_negative_variances_are_rejected(spark):
    with pytest.raises(ValueError):
        ind.filtered_price(series(spark, walk(10)), delta=-1.0)


def test_metrics_by_name(spark):
    df = ind.with_metrics(series(spark, walk(40)), [("mean", {"t": 5}), ("max", {"t": 9}), ("rsi", {}), ("boll", {"n": 20})])
    assert {"mean_5", "max_9", "rsi_w", "boll_mid"} <= set(df.columns)
    with pytest.raises(ValueError):
        ind.with_metrics(df, [("nope", {})])


def test_numbering_without_gathering(spark):
    rows = [("a", f"2024-01-{d:02d} 0{h}:00:00") for d in range(1, 9) for h in range(3)]
    df = spark.createDataFrame(rows, "symbol string, t string").withColumn("ts", F.to_timestamp("t"))
    got = [r.idx for r in numbered(df, F.to_date("ts")).orderBy("ts").collect()]
    assert got == list(range(24))


def test_setups_match_run_lengths(spark):
    from barflow.operators.sequences import SequenceRules, setups

    xs = walk(300, 9)
    got = {(r.idx, r.dir, r["count"]) for r in setups(series(spark, xs), SequenceRules(length=10**6)).filter("kind = 'setup'").collect()}
    want, run = set(), {1: 0, -1: 0}
    for i in range(5, len(xs)):
        for d in (1, -1):
            run[d] = run[d] + 1 if xs[i] * d > xs[i - 4] * d else 0
            if run[d]:
                want.add((i, d, run[d]))
    assert got == want


def test_countdown_starts_at_nine_and_is_cancelled(spark):
    from barflow.operators.sequences import setups

    falling = [200.0 - 2 * i for i in range(40)]
    rows = setups(series(spark, falling)).orderBy("idx", "kind").collect()
    down = [r["count"] for r in rows if r.kind == "countdown"]
    assert down[:13] == list(range(1, 14)) and down[13] == 1  # a finished run makes room for a new one
    first = min(r.idx for r in rows if r.kind == "countdown")
    assert [r["count"] for r in rows if r.idx == first and r.kind == "setup"] == [9]
    jump = falling[:16] + [400.0] + falling[17:]
    counts = [(r.idx, r["count"]) for r in setups(series(spark, jump)).orderBy("idx").collect() if r.kind == "countdown"]
    assert [c for i, c in counts if i < 16] == [1, 2, 3] and [c for i, c in counts if i >= 16][0] == 1


def test_short_series_as_the_feature_queries_have_them(spark, tmp_path):
    """Series of 1 to 90 bars: the feature queries give what their windows hold, as their SQL does; the features stay neutral."""
    import duckdb

    from barflow.registry import all_queries

    queries, oracles = all_queries()
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT k AS l_suppkey, n AS l_orderkey, 1 AS l_linenumber, n AS l_partkey, ((k * 31 + n * 17) % 50 + 1)::DOUBLE AS l_quantity, (900 + (n * n * 7919 + k * 104729) % 90000 / 100)::DOUBLE AS l_extendedprice, (n % 10) / 100 AS l_discount, (n % 8) / 100 AS l_tax, 'A' AS l_returnflag, TIMESTAMP '1995-01-01' + n * INTERVAL 1 DAY AS l_shipdate FROM range(1, 91) a(k), range(90) b(n) WHERE n < k")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    shown = lambda v: None if v is None else repr(round(float(v), 6) + 0.0) if isinstance(v, (float, Decimal)) else v
    for name in ("rule01_price_features", "rule02_feature_score", "rule04_blend"):
        df = queries[name](spark, str(tmp_path))
        sql = con.execute(oracles[name])
        order = [df.columns.index(d[0]) for d in sql.description]
        want = sorted([tuple(map(shown, row)) for row in sql.fetchall()], key=str)
        assert sorted([tuple(shown(row[i]) for i in order) for row in df.collect()], key=str) == want, name
    one = ind.price_features(series(spark, [100.0, 101.0])).filter("idx = 1").first()
    assert (one.rsi, one.boll_pct_b, one.price_return_10, one.macd_value) == (50.0, 50.0, 0.0, 0.0)


def test_recurrence_in_order_equals_a_loop_to_the_last_bit(spark):
    """Running sums do not, and the slope of a histogram near zero shows it."""
    rnd = random.Random(4)
    xs = {k: [float(rnd.randrange(99000, 101000)) for _ in range(n)] for k, n in (("a", 2500), ("b", 3), ("c", 1200))}
    df = functools.reduce(lambda x, y: x.unionByName(y), [series(spark, v, k) for k, v in xs.items()])
    specs = [Recur("y", F.col("close"), 2 / 13, F.col("close")), Recur("z", F.col("close"), 2 / 27, F.lit(5.0), at=5)]
    want = {}
    for k, v in xs.items():
        y = z = None
        for i, x in enumerate(v):
            y = x if i == 0 else 2 / 13 * x + (1 - 2 / 13) * y
            z = None if i < 5 else 5.0 if i == 5 else 2 / 27 * x + (1 - 2 / 27) * z
            want[k, i] = (y, z)
    got = {(r.symbol, r.idx): (r.y, r.z) for r in recur_in_order(arranged(df, SERIES), SERIES, specs).collect()}
    assert got == want
    summed = {(r.symbol, r.idx): (r.y, r.z) for r in recur(df, SERIES, specs).collect()}
    assert summed != want
