import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.operators import structure as S
from barflow.operators.structure import lines as LN
from barflow.operators.structure import points as P
from barflow.operators.structure import segments as SG
from barflow.operators.structure import zones as ZN
from barflow.operators.structure.kernel import DOWN, FLAT, UP, StrokeFold


def fold(pairs, **conf):
    f = StrokeFold(S.StructureConfig(**conf), keep_merged=True)
    for i, (h, l) in enumerate(pairs):
        f.push(i, float(h), float(l))
    return f


def zigzag(ends, step=4):
    """Bars moving straight between the ends, `step` bars per leg, each one wide."""
    out = []
    for a, b in zip(ends, ends[1:]):
        out += [a + (b - a) * k / step for k in range(step)]
    out.append(ends[-1])
    return [(x + 0.5, x - 0.5) for x in out]


def lines(spark, **series):
    """Lines between the given ends; a value of 0.5 added to an end says that the line to it is still open."""
    rows = []
    for s, ends in series.items():
        for n, (a, b) in enumerate(zip(ends, ends[1:])):
            low, high = min(a, b), max(a, b)
            rows.append((s, n, b > a, float(a), float(b), float(high), float(low), True, True, n, float(low), float(high), n, float(low), float(high), n, n))
    schema = "symbol string, pos int, up boolean, begin double, end double, high double, low double, sure boolean, used boolean, a_bar int, a_low double, a_high double, b_bar int, b_low double, b_high double, first_bar int, last_bar int"
    return spark.createDataFrame(rows, schema)


# ---- hand-made cases ------------------------------------------------------------------------------------------


def test_inclusion_up_and_down():
    up = fold([(10, 8), (12, 9), (11.5, 9.5)]).done
    assert [(m.high, m.low) for m in up] == [(10, 8), (12, 9.5)]
    down = fold([(10, 8), (9, 7), (8.5, 7.5)]).done
    assert [(m.high, m.low) for m in down] == [(10, 8), (8.5, 7)]


def test_one_price_bar_at_the_extreme_does_not_move_the_range():
    m = fold([(10, 8), (12, 9), (12, 12)]).done
    assert [(x.high, x.low, x.hi_bar) for x in m][1] == (12, 9, 2)


def test_fractal_needs_strict_neighbours():
    assert [m.fx for m in fold([(10, 8), (12, 9), (11, 8.5)]).done] == [FLAT, UP, FLAT]
    assert [m.fx for m in fold([(10, 8), (8, 6), (9, 7)]).done] == [FLAT, DOWN, FLAT]
    assert [m.fx for m in fold([(10, 8), (12, 9), (12, 8.5)]).done] == [FLAT, FLAT]


def test_stroke_span_three_is_rejected_and_four_accepted():
    assert fold(zigzag([10, 5, 15, 5], step=3)).strokes() == []
    assert [x.up for x in fold(zigzag([10, 5, 15, 5], step=4)).strokes() if x.sure] == [True]
    loose = zigzag([10, 5, 15, 5], step=3)
    assert fold(loose, bi_strict=False).strokes() == []  # only two raw bars between the ends
    loose.insert(5, (loose[4][0] - 0.1, loose[4][1] + 0.1))  # a contained bar is the third
    assert [x.up for x in fold(loose, bi_strict=False).strokes()][:1] == [True]


@pytest.mark.parametrize("mode", ["strict", "loss", "half", "totally"])
def test_check_modes_on_a_clear_zigzag(mode):
    s = fold(zigzag([10, 5, 20, 6, 25, 8], step=6), bi_fx_check=mode).strokes()
    assert [x.up for x in s][:3] == [True, False, True]


def test_same_side_extension_and_tail():
    f = fold(zigzag([10, 5, 15, 13, 18, 9], step=4))
    s = f.strokes()
    assert s[0].up and s[0].end == 18.5 and s[0].begin == 4.5
    assert not s[-1].sure


@pytest.mark.parametrize("n", [0, 1, 2, 29])
def test_short_and_constant_series(n):
    assert fold([(5, 5)] * n).strokes() == []


def test_segments_by_hand(spark):
    x = lines(
        spark,
        # up, pullback, higher, deep break: the third element reaches below the one before
        plain=[10, 20, 15, 30, 18, 25, 12, 22, 8, 12],
        few=[10, 20, 15],
        # the second element opens a gap above the first; the fall's own turn back ends the rise for sure
        gap=[10, 20, 15, 40, 30, 38, 24, 34, 20, 28, 22, 36, 26, 45],
        # the same without the turn back: told by nothing yet
        waits=[10, 20, 15, 40, 30, 38, 24, 34, 20],
    )
    got = {}
    for r in SG.segments(x).orderBy("symbol", "pos").collect():
        got.setdefault(r.symbol, []).append((r.ref_a, r.ref_b, r.up, r.sure, r.why))
    assert got["plain"][0] == (0, 2, True, True, "turn")
    assert "few" not in got
    assert got["gap"][0] == (0, 2, True, True, "turn")
    assert got["waits"][0] == (0, 2, True, False, "turn")


def random_ends(r, n):
    x, ends, up = 100.0, [100.0], True
    for _ in range(n):
        x = x + r.uniform(1, 20) * (1 if up else -1)
        ends.append(x)
        up = not up
    return ends


@pytest.mark.parametrize("algo", ["chan", "1+1", "break"])
def test_segments_are_contiguous(spark, algo):
    import random

    r = random.Random(5)
    x = lines(spark, **{f"s{k}": random_ends(r, r.randint(3, 60)) for k in range(60)})
    for left in ("peak", "all"):
        series = {}
        for s in SG.segments(x, algo, left).orderBy("symbol", "pos").collect():
            series.setdefault(s.symbol, []).append(s)
        assert len(series) > 50
        for seg in series.values():
            assert seg[0].ref_a == 0
            if algo != "1+1":
                assert all(p.ref_b + 1 == q.ref_a for p, q in zip(seg, seg[1:]))
            assert all(not s.sure or s.ref_b - s.ref_a >= 2 for s in seg)
            if algo == "chan":
                assert all(not s.sure or (s.ref_b - s.ref_a) % 2 == 0 for s in seg if s.ref_a > 0)


def test_a_long_look_ahead_changes_nothing(spark, monkeypatch):
    """Contracting lines show no end for long: the starts that see none within the look-ahead get all their successors."""
    import random

    r = random.Random(8)
    ends = [100 + (-1) ** k * 60 * 0.97**k for k in range(90)] + random_ends(r, 60)[1:]
    x = lines(spark, a=ends, b=random_ends(r, 80))
    want = sorted(map(tuple, SG.segments(x).collect()))
    monkeypatch.setattr(SG, "AHEAD", 2)
    assert sorted(map(tuple, SG.segments(x).collect())) == want and len(want) > 5


def zones_of(spark, ends, **conf):
    x = lines(spark, s=ends)
    seg = SG.segments(x)
    return ZN.zones(SG.owned(x, seg), seg, S.StructureConfig(**conf)).orderBy("idx").collect()


def test_zone_needs_overlap_not_touch(spark):
    # within an up segment the falling strokes 20-15 and 24-17 overlap in 17..20
    z = zones_of(spark, [10, 20, 15, 24, 17, 40, 12, 30, 5])
    assert z and z[0].low < z[0].high
    touch = zones_of(spark, [10, 20, 15, 26, 20, 40, 12, 30, 5])
    assert all((t.low, t.high) != (20, 20) for t in touch)


def plain_zones(ends, seg, mode="zs"):
    """Two neighbouring lines against a segment that overlap; what meets their range stays; near zones of a segment merge."""
    out = []
    n = len(ends) - 1
    parts = [(s.ref_a, s.ref_b, s.up) for s in seg] + ([(seg[-1].ref_b + 1, n - 1, not seg[-1].up)] if seg else [])
    for owner, (a, b, up) in enumerate(parts):
        own, loose = [], None
        for p in (p for p in range(a, b + 1) if (ends[p + 1] > ends[p]) != up):
            low, high = sorted(ends[p : p + 2])
            if own and loose is None and high > own[-1][2] and own[-1][3] > low:
                z = own[-1]
                own[-1] = (z[0], p, z[2], z[3], min(z[4], low), max(z[5], high))
            else:
                was, loose = loose, (p, low, high)
                if was and min(was[2], high) > max(was[1], low) and was[0] > 0:
                    own.append((was[0], p, max(was[1], low), min(was[2], high), min(was[1], low), max(was[2], high)))
                    loose = None
                else:
                    continue
            while len(own) > 1:
                x, y = own[-2:]
                near = (y[3] >= x[2] and x[3] >= y[2]) if mode == "zs" else (y[5] > x[4] and x[5] > y[4])
                if not near:
                    break
                own[-2:] = [(x[0], y[1], min(x[2], y[2]), max(x[3], y[3]), min(x[4], y[4]), max(x[5], y[5]))]
        out += [(owner, *z) for z in own]
    return out


@pytest.mark.parametrize("mode", ["zs", "peak"])
def test_zones_equal_a_plain_search(spark, mode):
    import random

    r = random.Random(3)
    series = {f"s{k}": [100.0 + r.uniform(0, 4) * (-1) ** i + i * r.uniform(-0.3, 0.3) for i in range(r.randint(4, 90))] for k in range(25)}
    series = {s: [v for i, v in enumerate(e) if i < 2 or (e[i] - e[i - 1]) * (e[i - 1] - e[i - 2]) < 0] for s, e in series.items()}
    series = {s: e[: next((i for i in range(2, len(e)) if (e[i] - e[i - 1]) * (e[i - 1] - e[i - 2]) >= 0), len(e))] for s, e in series.items()}
    x = lines(spark, **series)
    seg = SG.segments(x).cache()
    by = {}
    for s in seg.orderBy("symbol", "pos").collect():
        by.setdefault(s.symbol, []).append(s)
    want = sorted((s, *z) for s, e in series.items() for z in plain_zones(e, by.get(s, []), mode))
    got = ZN.zones(SG.owned(x, seg), seg, S.StructureConfig(zs_combine_mode=mode)).select("symbol", "owner", "begin", "end", "low", "high", "peak_low", "peak_high")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30


def test_versions_equal_a_fresh_run_after_every_bar(bars):
    """The strokes valid after a bar are those of the bars up to it, for each bar, the last one included."""
    b = bars.filter("symbol in ('1', '2')")
    v = S.stroke_versions(b).collect()
    for symbol in ("1", "2"):
        rows = b.filter(F.col("symbol") == symbol).orderBy("idx").select("idx", "high", "low").collect()
        f = StrokeFold(S.StructureConfig())
        mine = [r for r in v if r.symbol == symbol]
        for r in rows:
            f.push(r.idx, r.high, r.low)
            want = [tuple(s) for s in f.strokes()]
            got = sorted(tuple(m[1:-2]) for m in mine if m.from_bar <= r.idx and (m.to_bar is None or m.to_bar >= r.idx))
            assert got == want
    late = S.stroke_versions(b, skip=10**6).collect()
    last = {r.symbol: r.m for r in b.groupBy("symbol").agg(F.max("idx").alias("m")).collect()}
    assert all(r.from_bar == last[r.symbol] and r.to_bar is None for r in late) and late


def test_structure_at_a_bar_is_that_of_the_bars_so_far(bars):
    b = bars.filter("symbol in ('1', '2', '3')")
    last = b.groupBy("symbol").agg(F.max("idx").alias("bar"))
    at = b.filter("idx in (0, 40, 333)").select("symbol", F.col("idx").alias("bar")).unionByName(last)
    s = S.structure_at(b, at)
    for bar in (40, 333, None):
        some = b if bar is None else b.filter(F.col("idx") <= bar)
        fresh = S.build(some, S.StructureConfig())
        ends = {r.symbol: r.bar for r in last.collect()}
        for kind in ("strokes", "segments", "zones"):
            want = sorted(map(str, getattr(fresh, kind).collect()))
            got = [r.asDict() for r in getattr(s, kind).collect()]
            got = [r for r in got if int(r["symbol"].split("@")[1]) == (ends[r["symbol"].split("@")[0]] if bar is None else bar)]
            from pyspark.sql import Row

            assert sorted(str(Row(**(r | {"symbol": r["symbol"].split("@")[0]}))) for r in got) == want, (kind, bar)


@pytest.mark.parametrize("how", [{}, {"zs_combine_mode": "peak"}, {"zs_algo": "over_seg"}, {"zs_algo": "auto", "one_bi_zs": True}])
def test_zone_extension_and_merge(spark, how):
    import random

    r = random.Random(11)
    x = lines(spark, **{f"s{k}": random_ends(r, 40) for k in range(100)})
    seg = SG.segments(x)
    z = ZN.zones(SG.owned(x, seg), seg, S.StructureConfig(**how)).collect()
    assert all(v.low < v.high and v.peak_low <= v.low and v.high <= v.peak_high and v.begin > 0 for v in z)
    assert z and (any(v.parts for v in z) or "zs_algo" in how)  # there, neighbours rarely come near enough


def test_unknown_settings_are_rejected():
    with pytest.raises(ValueError):
        S.StructureConfig.from_dict({"nope": 1})
    with pytest.raises(ValueError):
        S.StructureConfig.from_dict({"bi_fx_check": "never"})
    with pytest.raises(ValueError):
        S.PointRules(bs_type="9")
    c = S.StructureConfig.from_dict({"divergence_rate": 0.7, "macd_algo-buy": "area", "max_bs2_rate-seg": 0.5})
    assert c.buy.macd_algo == "area" and c.sell.macd_algo == "peak" and c.seg_buy.macd_algo == "slope"
    assert c.buy.divergence_rate == 0.7 and c.seg_sell.max_bs2_rate == 0.5


# ---- invariants on the fixture --------------------------------------------------------------------------------


def test_merged_bars_never_contain_each_other(bars):
    m = S.merged_bars(bars)
    w = Window.partitionBy("symbol").orderBy("mb_idx")
    nh, nl = F.lead("high").over(w), F.lead("low").over(w)
    x = m.withColumns({"nh": nh, "nl": nl}).filter("(high >= nh AND low <= nl) OR (high <= nh AND low >= nl)")
    assert x.count() == 0
    assert m.agg(F.sum("n_bars")).first()[0] == bars.count()


def test_stroke_invariants(structure):
    s = structure.strokes
    w = Window.partitionBy("symbol").orderBy("idx")
    x = s.withColumns({"pd": F.lag("dir").over(w), "pe": F.lag("end_mb").over(w)})
    assert x.filter("pd = dir OR pe <> begin_mb").count() == 0
    assert s.filter("is_sure AND end_mb - begin_mb < 4").count() == 0
    assert s.filter("(dir = 1 AND begin_val >= end_val) OR (dir = -1 AND begin_val <= end_val)").count() == 0


def test_segment_and_zone_invariants(structure):
    assert structure.segments.filter("is_sure AND (stroke_cnt < 3 OR (dir = 1) <> (end_val > begin_val))").count() == 0
    assert structure.zones.filter("low >= high OR peak_low > low OR peak_high < high").count() == 0
    owned = structure.strokes.join(structure.segments.select("symbol", F.col("idx").alias("seg_idx"), "begin_stroke", "end_stroke"), ["symbol", "seg_idx"])
    assert owned.filter("idx < begin_stroke OR idx > end_stroke").count() == 0


def test_sub_peaks_can_be_forbidden(bars):
    a = S.build(bars, S.StructureConfig(bi_allow_sub_peak=False)).strokes.count()
    b = S.build(bars, S.StructureConfig()).strokes.count()
    assert 0 < a <= b


def test_strengths_by_hand(structure, bars):
    from barflow.operators import indicators as ind
    from barflow.operators.structure.strength import with_strengths

    m = ind.rsi_wilder(ind.macd(bars)).withColumn("turnover_rate", F.col("volume"))
    got = with_strengths(structure.strokes, m, {"area", "peak", "full_area", "diff", "slope", "amp", "rsi", "volumn", "volumn_avg"}).collect()
    hist: dict = {}
    for r in m.select("symbol", "idx", "macd", "volume", "rsi_w").collect():
        hist[r.symbol, r.idx] = r
    for g in got[:60]:
        whole = [hist[g.symbol, i] for i in range(g.first_bar, g.last_bar + 1)]
        inner = [hist[g.symbol, i] for i in range(g.begin_bar, g.end_bar + 1)]
        same = lambda rows: [abs(r.macd) for r in rows if r.macd * g.dir > 0]
        assert g.in_peak == pytest.approx(max([1e-7, *same(whole)]))
        assert g.in_full_area == pytest.approx(1e-7 + sum(same(inner)))
        assert g.in_diff == pytest.approx(max(r.macd for r in whole) - min(r.macd for r in whole))
        assert g.in_volumn == pytest.approx(sum(r.volume for r in whole))
        assert g.in_volumn_avg == pytest.approx(sum(r.volume for r in whole) / len(inner))
        assert g.in_rsi == pytest.approx(max(r.rsi_w for r in whole) if g.dir == 1 else 10000 / (min(r.rsi_w for r in whole) + 1e-7))
        area = 1e-7
        for i in range(g.end_bar, g.first_bar - 1, -1):
            if hist[g.symbol, i].macd * hist[g.symbol, g.end_bar].macd <= 0:
                break
            area += abs(hist[g.symbol, i].macd)
        assert g.out_area == pytest.approx(area)


# ---- points against a plain search ----------------------------------------------------------------------------


def brute_points(L, G, Z, strength, rate=0.7):
    """Points of one symbol by direct search over its lists; default rules with minimum zone count 0."""
    n, last = len(L), len(G) - 1
    zones = {g["idx"]: [z for z in Z if z["seg_idx"] == g["idx"]] for g in G}
    multi = {k: [z for z in v if not z["is_single"]] for k, v in zones.items()}
    owner = lambda i: L[i]["seg_idx"]
    found: dict[int, set] = {}
    for g in G:
        e, zs = g["end_stroke"], zones[g["idx"]]
        z = zs[-1] if zs else None
        x, falling = L[e], L[e]["dir"] == -1
        if z and not z["is_single"] and ((z["end_line"] + 1 < n and z["end_line"] + 1 >= e) or z["end_line"] >= e) and e - (z["begin_line"] - 1) > 2:
            out = L[z["end_line"] + 1] if z["end_line"] + 1 < n else None
            inner = [L[i] for i in range(z["begin_line"], z["end_line"] + 1) if i <= e]
            peak = out is not None and not any(y["low"] < out["low"] if out["dir"] == -1 else y["high"] > out["high"] for y in inner)
            beyond = x["low"] < z["low"] if falling else x["high"] > z["high"]
            if peak and beyond and strength[e] <= rate * strength[z["begin_line"] - 1]:
                found.setdefault(e, set()).add("1")
        elif e >= 2 and owner(e) == owner(e - 2) and x["dir"] == g["dir"]:
            new = x["low"] <= L[e - 2]["low"] if falling else x["high"] >= L[e - 2]["high"]
            if new and strength[e] <= rate * strength[e - 2]:
                found.setdefault(e, set()).add("1p")
    amp = lambda y: abs(y["end_val"] - y["begin_val"])
    meets = lambda lo, hi, y: y["high"] > lo and hi > y["low"]
    for g in G:
        e = g["end_stroke"]
        if len(G) < 2 or e + 2 >= n or e not in found:
            continue
        br, two = L[e + 1], L[e + 2]
        if amp(two) / amp(br) <= 0.9999:
            found.setdefault(e + 2, set()).add("2")
        lo, hi, k = two["low"], two["high"], e + 4
        while k < n:
            s = L[k]
            if owner(k) != owner(e + 2) and (owner(k) < last or owner(k) - owner(e + 2) >= 2 or G[owner(e + 2)]["is_sure"]):
                break
            if not meets(lo, hi, s):
                break
            if k == e + 4:
                lo, hi = max(lo, s["low"]), min(hi, s["high"])
            if (s["low"] < br["low"] if s["dir"] == -1 else s["high"] > br["high"]) or abs(s["end_val"] - br["end_val"]) / amp(br) > 0.9999:
                break
            found.setdefault(k, set()).add("2s")
            k += 2
    back = lambda y, z: y["low"] < z["high"] if y["dir"] == -1 else y["high"] > z["low"]
    for pos, g in enumerate(G):
        e = g["end_stroke"]
        if len(G) < 2 or e not in found:
            continue
        ng = G[pos + 1] if pos < last else None
        if ng and multi[ng["idx"]]:
            z = multi[ng["idx"]][0]
            k = z["end_line"] + 2
            if k < n:
                o = owner(k)
                parent = G[o] if o <= last else None
                ok = (parent is not None or ng["idx"] == last) and not (parent is not None and o != ng["idx"] and parent["stroke_cnt"] >= 3)
                ok = ok and L[k]["dir"] != ng["dir"] and not (o != pos + 1 and pos + 1 < len(G) - 2)
                if ok and not back(L[k], z):
                    found.setdefault(k, set()).add("3a")
        if multi[g["idx"]]:
            z = multi[g["idx"]][-1]
            limit = n
            if ng and not (not multi[ng["idx"]] and pos + 1 == last):
                exits = [y["end_line"] + 1 for y in multi[ng["idx"]] if y["end_line"] + 1 < n]
                limit = exits[0] if exits else ng["end_stroke"] - 1
            for k in range(e + 2, n, 2):
                if k > limit or (owner(k) != pos + 1 and owner(k) < last):
                    break
                if not back(L[k], z):
                    found.setdefault(k, set()).add("3b")
                    break
    return found


def test_points_equal_a_plain_search(spark, structure, points, bars):
    from barflow.operators import indicators as ind
    from barflow.operators.structure.strength import with_strengths

    per = lambda df, order: {}
    L, G, Z, st = {}, {}, {}, {}
    for r in with_strengths(structure.strokes, ind.macd(bars), {"peak"}).orderBy("symbol", "idx").collect():
        L.setdefault(r.symbol, []).append(r.asDict())
        st.setdefault(r.symbol, []).append(r.in_peak)
    for r in structure.segments.orderBy("symbol", "idx").collect():
        G.setdefault(r.symbol, []).append(r.asDict())
    for r in structure.zones.orderBy("symbol", "idx").collect():
        Z.setdefault(r.symbol, []).append(r.asDict())
    want = {(s, k): sorted(v) for s in G for k, v in brute_points(L[s], G[s], Z.get(s, []), st[s]).items()}
    got = {(r.symbol, r.line): sorted(r.types) for r in points.collect()}
    assert got == want
    assert len({t for v in got.values() for t in v}) >= 4


def test_a_falling_stroke_carries_the_buys(structure, points):
    x = points.join(structure.strokes.select("symbol", F.col("idx").alias("line"), "dir"), ["symbol", "line"])
    assert x.filter("is_buy <> (dir = -1)").count() == 0
    assert x.count() == points.count()


def test_latest_points_and_tables(structure, points):
    one = P.latest_points(points, 1)
    assert one.groupBy("symbol").count().filter("count > 1").count() == 0
    t = LN.trend_lines(structure.strokes, structure.segments)
    assert t.filter("side = 'support'").count() > 0
    assert LN.structure_state(structure.zones, structure.segments).filter("state = 'trend'").count() >= 0


def test_trend_line_of_collinear_points(spark):
    x = spark.createDataFrame([([(30, 3.0), (20, 2.0), (10, 1.0)],)], "p array<struct<x:int,y:double>>")
    for steep in (True, False):
        r = x.select(LN.best_line(F.col("p"), F.lit(1.0), steep).alias("l")).select("l.*").first()
        assert r.slope == pytest.approx(0.1) and (r.x, r.y, r.far) == (30.0, 3.0, pytest.approx(0.0))
