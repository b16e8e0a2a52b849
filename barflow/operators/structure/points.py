"""Buy and sell points as joins and windows over the line, group and zone tables.

The same code serves strokes inside segments and segments inside segments of segments: `lines` are the moves,
`groups` the runs of moves, `zones` the overlaps found among the lines. A point sits on the end of a line; a
falling line can only carry a buy point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.structure.config import PointRules
from barflow.operators.structure.strength import with_strengths
from barflow.operators.structure.tables import Structure
from barflow.session import cut, in_place, placed

KEY = "symbol"
# Names of the features a point can carry.
FEATURES = ("divergence_rate", "zs_cnt", "bsp1_bi_amp", "bsp2_retrace_rate", "bsp2_break_bi_amp", "bsp2_bi_amp",
            "bsp2s_retrace_rate", "bsp2s_break_bi_amp", "bsp2s_bi_amp", "bsp2s_lv", "bsp3_zs_height", "bsp3_bi_amp")
STAGE = {"1": 1, "1p": 1, "2": 2, "2s": 3, "3a": 4, "3b": 5}


@dataclass(frozen=True)
class Sides:
    """Rules of both sides, read through a boolean column."""

    buy: PointRules
    sell: PointRules

    def get(self, name: str, is_buy: Column) -> Column:
        b, s = getattr(self.buy, name), getattr(self.sell, name)
        return F.lit(b) if b == s else F.when(is_buy, F.lit(b)).otherwise(F.lit(s))

    def wants(self, kind: str, is_buy: Column) -> Column:
        return F.when(is_buy, F.lit(kind in self.buy.types)).otherwise(F.lit(kind in self.sell.types))

    def metric(self, way: str, where: str, is_buy: Column) -> Column:
        b, s = (F.col(f"{where}.{way}_{r.macd_algo}") for r in (self.buy, self.sell))
        return b if self.buy.macd_algo == self.sell.macd_algo else F.when(is_buy, b).otherwise(s)

    @property
    def algos(self) -> set[str]:
        return {self.buy.macd_algo, self.sell.macd_algo}


def series():
    return Window.partitionBy(KEY)


def falls(where: str) -> Column:
    return F.col(f"{where}.dir") == -1


def overlap(l1, h1, l2, h2) -> Column:
    return (h2 > l1) & (h1 > l2)


def reenters(line: str, zone: str) -> Column:
    """A pullback that comes back into the zone."""
    return F.when(falls(line), F.col(f"{line}.low") < F.col(f"{zone}.high")).otherwise(
        F.col(f"{line}.high") > F.col(f"{zone}.low")
    )


def _line_table(lines: DataFrame, algos: set[str]) -> DataFrame:
    metrics = [f"{w}_{a}" for a in sorted(algos) for w in ("in", "out")]
    packed = F.struct(
        "idx", "dir", "high", "low", "begin_val", "end_val", "begin_bar", "end_bar", "seg_idx", "is_sure",
        F.abs(F.col("end_val") - F.col("begin_val")).alias("amp"), *metrics,
    )
    before = F.struct("seg_idx", "low", "high", *[f"in_{a}" for a in sorted(algos)])
    return lines.select(
        KEY, "idx", packed.alias("x"), F.count("*").over(series()).alias("n_lines"), F.lag(before, 2).over(series().orderBy("idx")).alias("prev2"),
    )


def _at(table: DataFrame, name: str, key: str) -> DataFrame:
    """The line table keyed by `key`, its line called `name`."""
    return table.select(KEY, F.col("idx").alias(key), F.col("x").alias(name))


def _zone_lists(zones: DataFrame) -> DataFrame:
    packed = F.struct("idx", "begin_line", "end_line", "low", "high", "peak_low", "peak_high", "is_single")
    return zones.groupBy(KEY, F.col("seg_idx").alias("g")).agg(F.sort_array(F.collect_list(packed)).alias("zs"))


def _groups(groups: DataFrame, zones: DataFrame) -> DataFrame:
    """Groups with their zones, the next group, `me` where a series has one group only, and the number of groups of the series."""
    base = groups.join(_zone_lists(zones), [KEY, "g"], "left").withColumn(
        "zs", F.coalesce("zs", F.expr("array()").cast("array<struct<idx:int,begin_line:int,end_line:int,low:double,high:double,peak_low:double,peak_high:double,is_single:boolean>>"))
    )
    base = base.withColumn("multi", F.filter("zs", lambda z: ~z["is_single"]))
    packed = F.struct("g", "dir", "is_sure", "begin", "end", "multi")
    return base.withColumns(
        {"n_groups": F.count("*").over(series()), "next": F.lead(packed).over(series().orderBy("g"))}
    ).withColumn("solo", F.col("n_groups") == 1).withColumn("me", F.when(F.col("solo"), packed))


def zone_exits(groups: DataFrame, table: DataFrame) -> DataFrame:
    """For the last zone of each group: extremes of its lines up to the group's end and the gap ratio to the exit."""
    z = groups.filter(F.size("zs") > 0).select(KEY, "g", "end", F.element_at("zs", -1).alias("z"))
    inner = z.select(
        KEY, "g", F.explode(F.sequence(F.col("z.begin_line"), F.greatest("z.begin_line", F.least("z.end_line", "end")))).alias("idx"),
        (F.col("z.end_line") + 1).alias("exit_idx"),
    )
    x = inner.join(table.select(KEY, "idx", "x"), [KEY, "idx"]).join(_at(table, "exit", "exit_idx"), [KEY, "exit_idx"])
    gap = F.abs(F.col("x.end_val") - F.col("exit.end_val")) / F.col("exit.end_val")
    beaten = F.when(falls("exit"), F.col("x.low") < F.col("exit.low")).otherwise(F.col("x.high") > F.col("exit.high"))
    return x.groupBy(KEY, "g").agg(
        (F.max(beaten.cast("int")) == 0).alias("exit_is_peak"),
        F.min(gap).alias("nearest_gap"),
    )


def _first_points(groups: DataFrame, table: DataFrame, sides: Sides) -> DataFrame:
    """Types 1 and 1p, both kept with a `target` flag: later types refer to points that are no targets too."""
    end = table.select(KEY, F.col("idx").alias("end"), F.col("x").alias("e"), "prev2", "n_lines")
    g = groups.join(end, [KEY, "end"]).join(zone_exits(groups, table), [KEY, "g"], "left")
    g = g.withColumn("z", F.when(F.size("zs") > 0, F.element_at("zs", -1)))
    g = g.withColumn("entry_idx", F.col("z.begin_line") - 1).join(_at(table, "entry", "entry_idx"), [KEY, "entry_idx"], "left")
    buy = F.col("dir") == -1
    exit_exists = F.col("z.end_line") + 1 < F.col("n_lines")
    trend = F.coalesce(
        ~F.col("z.is_single")
        & ((exit_exists & (F.col("z.end_line") + 1 >= F.col("end"))) | (F.col("z.end_line") >= F.col("end")))
        & (F.col("end") - F.col("entry_idx") > 2),
        F.lit(False),
    )
    count = F.when(sides.get("bsp1_only_multibi_zs", buy), F.size("multi")).otherwise(F.size("zs"))
    need = sides.get("min_zs_cnt", buy)
    enough = (need <= 0) | (count >= need)
    rate = sides.get("divergence_rate", buy)
    out_m, in_m, pre_m = sides.metric("out", "e", buy), sides.metric("in", "entry", buy), sides.metric("in", "prev2", buy)
    beyond = F.when(falls("e"), F.col("e.low") < F.col("z.low")).otherwise(F.col("e.high") > F.col("z.high"))
    diverges = beyond & ((rate > 100) | (out_m <= rate * in_m))
    peak_ok = ~sides.get("bs1_peak", buy) | (exit_exists & F.coalesce("exit_is_peak", F.lit(False)))
    inside = (
        (F.col("e.seg_idx") == F.col("prev2.seg_idx"))
        & (F.col("e.dir") == F.col("dir"))
        & F.when(falls("e"), F.col("e.low") <= F.col("prev2.low")).otherwise(F.col("e.high") >= F.col("prev2.high"))
    )
    return (
        g.withColumn("trend", trend)
        .filter(F.col("trend") | F.coalesce(inside, F.lit(False)))
        .select(
            KEY, "g", F.col("end").alias("line"), falls("e").alias("is_buy"),
            F.when(F.col("trend"), "1").otherwise("1p").alias("type"),
            F.coalesce(F.when(F.col("trend"), enough & peak_ok & diverges).otherwise(enough & (out_m <= rate * pre_m)), F.lit(False)).alias("target"),
            F.when(F.col("trend"), F.when(beyond, out_m / in_m)).otherwise(out_m / (pre_m + 1e-7)).alias("divergence_rate"),
            F.when(F.col("trend"), F.size("zs").cast("double")).alias("zs_cnt"),
            F.when(~F.col("trend"), F.col("e.amp")).alias("bsp1_bi_amp"),
        )
    )


def _anchored(groups: DataFrame, table: DataFrame) -> DataFrame:
    """Groups with the two lines after their end. The only group of a series is anchored before its first line."""
    a = groups.drop("zs").withColumn("anchor", F.when(F.col("solo"), F.lit(-1)).otherwise(F.col("end")))
    a = a.withColumns({"k1": F.col("anchor") + 1, "k2": F.col("anchor") + 2})
    counts = table.select(KEY, "n_lines").distinct()
    return (
        a.join(_at(table, "b1", "k1"), [KEY, "k1"], "left")
        .join(_at(table, "b2", "k2"), [KEY, "k2"], "left")
        .join(counts, KEY)
        .withColumn("side", F.when(F.col("solo"), F.col("dir") == 1).otherwise(F.col("dir") == -1))
    )


def _second_points(a: DataFrame, table: DataFrame, groups: DataFrame, sides: Sides) -> DataFrame:
    """Types 2 and 2s of every group, whether or not a first point backs it."""
    side = F.col("side")
    limit = sides.get("max_bs2_rate", side)
    down = F.col("dir") == -1
    base = a.filter(F.col("b2").isNotNull() & (sides.wants("2", down) | sides.wants("2s", down)))
    base = base.withColumn("rate2", F.col("b2.amp") / F.col("b1.amp"))
    two = base.filter(F.col("rate2") <= limit).select(
        KEY, "g", F.col("b2.idx").alias("line"), falls("b2").alias("is_buy"), F.lit("2").alias("type"),
        F.col("rate2").alias("bsp2_retrace_rate"), F.col("b1.amp").alias("bsp2_break_bi_amp"),
        F.col("b2.amp").alias("bsp2_bi_amp"),
    )
    own = groups.select(KEY, F.col("g").alias("g2"), F.col("is_sure").alias("g2_sure"))
    later = (
        base.filter(sides.wants("2s", down) & ((F.col("rate2") <= limit) | ~sides.get("bsp2s_follow_2", side)))
        .withColumn("g2", F.col("b2.seg_idx"))
        .join(own, [KEY, "g2"], "left")
        .withColumn("spill", (F.col("g2") + 1 >= F.col("n_groups") - 1) & ~F.coalesce("g2_sure", F.lit(False)))
        .select(KEY, "g", "side", "b1", "b2", F.explode(F.when(F.col("spill"), F.array("g2", F.col("g2") + 1)).otherwise(F.array("g2"))).alias("sg"))
    )
    cand = later.join(table.select(KEY, F.col("x.seg_idx").alias("sg"), F.col("x").alias("s")), [KEY, "sg"]).filter(
        (F.col("s.idx") > F.col("b2.idx")) & ((F.col("s.idx") - F.col("b2.idx")) % 2 == 0)
    )
    w = Window.partitionBy(KEY, "g").orderBy("s.idx")
    one = F.first("s").over(w)
    lo, hi = F.greatest("b2.low", one["low"]), F.least("b2.high", one["high"])
    lv = (F.col("s.idx") - F.col("b2.idx")) / 2
    rate = F.abs(F.col("s.end_val") - F.col("b1.end_val")) / F.col("b1.amp")
    most = sides.get("max_bsp2s_lv", side)
    breaks = F.when(falls("s"), F.col("s.low") < F.col("b1.low")).otherwise(F.col("s.high") > F.col("b1.high"))
    apart = F.when(lv == 1, ~overlap(F.col("b2.low"), F.col("b2.high"), F.col("s.low"), F.col("s.high"))).otherwise(
        ~overlap(lo, hi, F.col("s.low"), F.col("s.high"))
    )
    stop = (one["idx"] != F.col("b2.idx") + 2) | apart | breaks | (rate > limit) | F.coalesce(lv > most, F.lit(False))
    many = (
        cand.withColumns({"stop": stop.cast("int"), "lv": lv, "rate": rate})
        .withColumn("stopped", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("stopped = 0")
        .select(
            KEY, "g", F.col("s.idx").alias("line"), falls("s").alias("is_buy"), F.lit("2s").alias("type"),
            F.col("rate").alias("bsp2s_retrace_rate"), F.col("b1.amp").alias("bsp2s_break_bi_amp"),
            F.col("s.amp").alias("bsp2s_bi_amp"), F.col("lv").cast("double").alias("bsp2s_lv"),
        )
    )
    return two.unionByName(many, allowMissingColumns=True)


def _third_after(a: DataFrame, table: DataFrame, groups: DataFrame, sides: Sides) -> DataFrame:
    """Type 3a: the first pullback out of an early zone of the next group."""
    down = F.col("dir") == -1
    ng = F.when(F.col("solo"), F.col("me")).otherwise(F.col("next"))
    t = (
        a.withColumn("ng", ng)
        .filter(F.col("ng").isNotNull() & (sides.wants("3a", down) | sides.wants("3b", down)))
        .withColumns(
            {
                "next_idx": F.when(F.col("solo"), F.col("g")).otherwise(F.col("g") + 1),
                "strict_ok": ~sides.get("strict_bsp3", F.col("side")) | (F.col("ng.multi")[0]["begin_line"] - 1 == F.col("anchor") + 1),
                "most": sides.get("bsp3a_max_zs_cnt", F.col("ng.dir") == -1),
            }
        )
        .filter("strict_ok")
        .select(KEY, "g", "side", "ng", "next_idx", "n_groups", "most", F.posexplode("ng.multi").alias("k", "z"))
        .filter("k < most")
        .withColumn("b_idx", F.col("z.end_line") + 2)
        .join(_at(table, "b", "b_idx"), [KEY, "b_idx"], "left")
        .withColumn("pg", F.col("b.seg_idx"))
        .join(groups.select(KEY, F.col("g").alias("pg"), (F.col("end") - F.col("begin") + 1).alias("pg_lines")), [KEY, "pg"], "left")
    )
    stop = (
        F.col("b").isNull()
        | (F.col("pg_lines").isNull() & (F.col("ng.g") != F.col("n_groups") - 1))
        | (F.col("pg_lines").isNotNull() & (F.col("pg") != F.col("ng.g")) & (F.col("pg_lines") >= 3))
        | (F.col("b.dir") == F.col("ng.dir"))
        | ((F.col("b.seg_idx") != F.col("next_idx")) & (F.col("next_idx") < F.col("n_groups") - 2))
    )
    w = Window.partitionBy(KEY, "g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    tops = F.when(falls("b"), F.col("b.high") >= F.col("z.peak_high")).otherwise(F.col("b.low") <= F.col("z.peak_low"))
    return (
        t.withColumn("stopped", F.max(F.coalesce(stop, F.lit(True)).cast("int")).over(w))
        .filter(
            (F.col("stopped") == 0) & ~reenters("b", "z") & (~sides.get("bsp3_peak", F.col("side")) | tops)
        )
        .select(
            KEY, "g", F.col("b.idx").alias("line"), falls("b").alias("is_buy"), F.lit("3a").alias("type"),
            ((F.col("z.high") - F.col("z.low")) / F.col("z.low")).alias("bsp3_zs_height"), F.col("b.amp").alias("bsp3_bi_amp"),
        )
    )


def _third_before(a: DataFrame, table: DataFrame, sides: Sides) -> DataFrame:
    """Type 3b: the first pullback after the group's end that stays out of the group's last zone."""
    down = F.col("dir") == -1
    first_zone = F.filter("next.multi", lambda z: z["end_line"] + 1 < F.col("n_lines"))
    limit = (
        F.when(F.col("next").isNull(), F.lit(2**31 - 1))
        .when((F.size("next.multi") == 0) & (F.col("next.g") == F.col("n_groups") - 1), F.lit(2**31 - 1))
        .when(F.size(first_zone) > 0, first_zone[0]["end_line"] + 1)
        .otherwise(F.col("next.end") - 1)
    )
    nxt = F.col("g") + 1
    reach = F.when(nxt + 1 >= F.col("n_groups") - 1, F.array(nxt, nxt + 1, nxt + 2)).otherwise(F.array(nxt))
    t = (
        a.filter(~F.col("solo") & (F.size("multi") > 0) & (sides.wants("3a", down) | sides.wants("3b", down)))
        .withColumns({"z": F.element_at("multi", -1), "limit": limit, "reach": reach})
        .filter(~sides.get("strict_bsp3", F.col("side")) | ((F.col("z.end_line") + 1 == F.col("end")) & (F.col("end") < F.col("n_lines"))))
        .select(KEY, "g", "end", "z", "limit", F.explode("reach").alias("sg"))
    )
    cand = t.join(table.select(KEY, F.col("x.seg_idx").alias("sg"), F.col("x").alias("b")), [KEY, "sg"]).filter(
        (F.col("b.idx") >= F.col("end") + 2)
        & ((F.col("b.idx") - F.col("end")) % 2 == 0)
        & (F.col("b.idx") <= F.col("limit"))
        & ~reenters("b", "z")
    )
    return (
        cand.groupBy(KEY, "g")
        .agg(F.min_by(F.struct("b", "z"), F.col("b.idx")).alias("p"))
        .select(
            KEY, "g", F.col("p.b.idx").alias("line"), falls("p.b").alias("is_buy"), F.lit("3b").alias("type"),
            ((F.col("p.z.high") - F.col("p.z.low")) / F.col("p.z.low")).alias("bsp3_zs_height"),
            F.col("p.b.amp").alias("bsp3_bi_amp"),
        )
    )


def _backed(events: DataFrame, ends: DataFrame, marked: DataFrame, follow: Column) -> DataFrame:
    """Events of groups whose end line carries a point. A point set by an earlier group's event counts too, which
    can only happen among the last groups of a series, so one more round settles it."""
    free = ends.filter(~follow).select(KEY, "g")
    direct = ends.join(marked.select(KEY, F.col("line").alias("end")).distinct(), [KEY, "end"], "left_semi").select(KEY, "g").unionByName(free).distinct()
    first = events.join(direct, [KEY, "g"], "left_semi")
    hit = (
        first.select(KEY, F.col("line").alias("end"), F.col("g").alias("src"))
        .join(ends.select(KEY, "end", "g"), [KEY, "end"])
        .filter("src < g")
        .select(KEY, "g")
    )
    return events.join(direct.unionByName(hit).distinct(), [KEY, "g"], "left_semi")


def find_points(lines: DataFrame, groups: DataFrame, zones: DataFrame, buy: PointRules, sell: PointRules) -> DataFrame:
    """One row per line that carries a point: types, link to its first point and features.

    lines: symbol, idx, dir, high, low, begin_val, end_val, begin_bar, end_bar, seg_idx, is_sure and strengths;
    groups: symbol, g, dir, is_sure, begin, end (line numbers); zones: see `Structure.zones`. The result is written.
    """
    with in_place(lines.sparkSession):
        return cut(_points(placed(lines), placed(groups), placed(zones), Sides(buy, sell)))


def _points(lines: DataFrame, groups: DataFrame, zones: DataFrame, sides: Sides) -> DataFrame:
    table = cut(_line_table(lines, sides.algos))
    g = cut(_groups(groups, zones))
    ones = _first_points(g, table, sides)
    ones = ones.withColumn("kept", F.col("target") & F.when(F.col("type") == "1", sides.wants("1", F.col("is_buy"))).otherwise(sides.wants("1p", F.col("is_buy"))))
    ones = cut(ones)
    a = cut(_anchored(g, table))
    ends = g.select(KEY, "g", F.when(F.col("solo"), F.lit(-1)).otherwise(F.col("end")).alias("end"), F.when(F.col("solo"), F.col("dir") == 1).otherwise(F.col("dir") == -1).alias("side"))
    marked = ones.filter("kept")
    twos = cut(_backed(cut(_second_points(a, table, g, sides)), ends, marked, sides.get("bsp2_follow_1", F.col("side"))))
    marked2 = marked.select(KEY, "line").unionByName(twos.select(KEY, "line"))
    threes_all = cut(_third_after(a, table, g, sides).unionByName(_third_before(a, table, sides)))
    threes = _backed(threes_all, ends, marked2, sides.get("bsp3_follow_1", F.col("side")))
    link = ones.select(KEY, "g", F.col("line").alias("t1_line"))
    rest = twos.unionByName(threes, allowMissingColumns=True).join(link, [KEY, "g"], "left")
    wanted = F.lit(False)
    for kind in ("2", "2s", "3a", "3b"):
        wanted = F.when(F.col("type") == kind, sides.wants(kind, F.col("is_buy"))).otherwise(wanted)
    events = marked.drop("target").unionByName(rest.withColumn("kept", wanted), allowMissingColumns=True)
    stage = F.lit(0)
    for kind, n in STAGE.items():
        stage = F.when(F.col("type") == kind, n).otherwise(stage)
    events = events.withColumn("ord", F.struct(F.when(stage >= 4, 4).when(stage >= 2, 2).otherwise(1).alias("a"), "g", stage.alias("b")))
    feats = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) for f in FEATURES]
    out = events.groupBy(KEY, "line", "is_buy").agg(
        F.array_sort(F.collect_set("type")).alias("types"),
        F.min_by("t1_line", F.when(F.col("t1_line").isNotNull(), F.col("ord"))).alias("t1_line"),
        F.max("kept").alias("kept"),
        *feats,
    )
    x = table.select(KEY, F.col("idx").alias("line"), F.col("x.end_bar").alias("bar"), F.col("x.end_val").alias("price"), F.col("x.amp").alias("bsp_bi_amp"), F.col("x.is_sure").alias("is_sure"))
    entries = F.array(*[F.struct(F.lit(f).alias("k"), F.col(f).alias("v")) for f in ("bsp_bi_amp", *FEATURES)])
    return (
        out.filter("kept")
        .join(x, [KEY, "line"])
        .withColumn("features", F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())))
        .select(KEY, "line", "is_buy", "types", "t1_line", "bar", "price", "is_sure", "features")
    )


def stroke_lines(s: Structure, bars: DataFrame, extra: set[str] = frozenset()) -> DataFrame:
    """Strokes with the strengths the rules ask for, and `extra` ones. `bars` must carry the columns they read."""
    c = s.conf
    return with_strengths(s.strokes, bars, {c.buy.macd_algo, c.sell.macd_algo} | set(extra))


def stroke_points(s: Structure, bars: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Points on strokes, from bars (with macd for the default strength) or from prepared `stroke_lines`."""
    c = s.conf
    lines = stroke_lines(s, bars) if lines is None else lines
    groups = s.bare_segments.select(KEY, F.col("idx").alias("g"), "dir", "is_sure", F.col("begin_stroke").alias("begin"), F.col("end_stroke").alias("end"))
    return find_points(lines, groups, s.zones, c.buy, c.sell)


def segment_points(s: Structure) -> DataFrame:
    """The same rules one level up."""
    c = s.conf
    lines = with_strengths(s.segments, None, {c.seg_buy.macd_algo, c.seg_sell.macd_algo})
    groups = s.segsegs.select(KEY, F.col("idx").alias("g"), "dir", "is_sure", F.col("begin_seg").alias("begin"), F.col("end_seg").alias("end"))
    return find_points(lines, groups, s.seg_zones, c.seg_buy, c.seg_sell)


def latest_points(points: DataFrame, n: int = 1) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(F.desc("line"))
    return points.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
