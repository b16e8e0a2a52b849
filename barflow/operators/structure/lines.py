"""Attributes and relations of merged bars, strokes, segments and zones, all as windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.operators.structure.tables import Structure, merged_bars

KEY = "symbol"


def _w(order: str):
    return Window.partitionBy(KEY).orderBy(order)


def _next_fractal(fx: DataFrame) -> DataFrame:
    """Each fractal with its neighbours and the next fractal (b)."""
    m = _w("mb_idx")
    near = fx.withColumns({f"{a}{c}": f(x).over(m) for a, f in (("p", F.lag), ("n", F.lead)) for c, x in (("h", "high"), ("l", "low"))})
    only = near.filter("fractal <> 'none'")
    cols = ["mb_idx", "fractal", "high", "low", "ph", "pl", "nh", "nl"]
    return only.withColumn("b", F.lead(F.struct(*cols)).over(m)).filter("b IS NOT NULL")


def fractal_pairs(fx: DataFrame) -> DataFrame:
    """Validity of consecutive opposite fractals under the four end-check modes."""
    f = _next_fractal(fx).filter("b.fractal <> fractal")
    top = F.col("fractal") == "top"

    def check(a_low: list, b_high: list, a_high: list, b_low: list) -> Column:
        return F.when(top, (F.col("high") > F.greatest(*b_high)) & (F.col("b.low") < F.least(*a_low))).otherwise(
            (F.col("low") < F.least(*b_low)) & (F.col("b.high") > F.greatest(*a_high))
        )

    bh, bl = [F.col("b.ph"), F.col("b.high"), F.col("b.nh")], [F.col("b.pl"), F.col("b.low"), F.col("b.nl")]
    ah, al = [F.col("ph"), F.col("high"), F.col("nh")], [F.col("pl"), F.col("low"), F.col("nl")]
    loss = F.when(top, (F.col("high") > F.col("b.high")) & (F.col("b.low") < F.col("low"))).otherwise((F.col("low") < F.col("b.low")) & (F.col("b.high") > F.col("high")))
    return f.select(
        KEY, "mb_idx", F.col("b.mb_idx").alias("b_idx"), check(al, bh, ah, bl).alias("strict"), loss.alias("loss"),
        check(al[1:], bh[:2], ah[1:], bl[:2]).alias("half"),
        F.when(top, F.col("low") > F.greatest(*bh)).otherwise(F.col("high") < F.least(*bl)).alias("totally"),
    )


def fractal_spans(fx: DataFrame) -> DataFrame:
    """Merged-bar distance to the next fractal, with and without gaps counted as bars."""
    gaps = F.sum(F.col("gap").cast("int")).over(_w("mb_idx").rowsBetween(Window.unboundedPreceding, -1))
    x = fx.withColumn("gaps_before", F.coalesce(gaps, F.lit(0))).filter("fractal <> 'none'")
    x = x.withColumn("b", F.lead(F.struct("mb_idx", "gaps_before")).over(_w("mb_idx"))).filter("b IS NOT NULL")
    span = F.col("b.mb_idx") - F.col("mb_idx")
    return x.select(KEY, "mb_idx", F.col("b.mb_idx").alias("b_idx"), span.alias("span"), (span + F.col("b.gaps_before") - F.col("gaps_before")).cast("int").alias("span_gaps"), (span >= 4).alias("strict_ok"))


def ends_are_peaks(fx: DataFrame) -> DataFrame:
    """Whether nothing between a fractal and the next one goes beyond the next one.

    Merged bars between two fractals carry the number of the fractal before them, so their extremes are one
    aggregation away."""
    f = fx.withColumn("run", F.sum(F.when(F.col("fractal") != "none", 1).otherwise(0)).over(_w("mb_idx").rowsBetween(Window.unboundedPreceding, 0)))
    inner = f.filter("fractal = 'none'").groupBy(KEY, "run").agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    ends = f.filter("fractal <> 'none'").withColumn("b", F.lead(F.struct("mb_idx", "high", "low")).over(_w("mb_idx"))).filter("b IS NOT NULL")
    x = ends.join(inner, [KEY, "run"], "left")
    beaten = F.when(F.col("fractal") == "top", F.col("bottom") < F.col("b.low")).otherwise(F.col("top") > F.col("b.high"))
    return x.select(KEY, "mb_idx", F.col("b.mb_idx").alias("b_idx"), (~F.coalesce(beaten, F.lit(False))).alias("is_peak"))


def settled(strokes: DataFrame) -> DataFrame:
    """Strokes that later bars can no longer change: those before the last confirmed one."""
    base = F.max(F.when(F.col("used_sure"), F.col("idx"))).over(Window.partitionBy(KEY))
    return strokes.withColumn("_last", base).filter(F.col("idx") < F.col("_last")).drop("_last")


def stroke_attributes(strokes: DataFrame) -> DataFrame:
    return strokes.withColumns(
        {
            "amp": F.abs(F.col("end_val") - F.col("begin_val")),
            "bar_cnt": F.col("end_bar") - F.col("begin_bar") + 1,
            "merged_cnt": F.col("end_mb") - F.col("begin_mb") + 1,
            "mid": (F.col("high") + F.col("low")) / 2,
        }
    )


def segment_attributes(segments: DataFrame) -> DataFrame:
    move = F.col("end_val") - F.col("begin_val")
    return segments.withColumns(
        {
            "slope": move / (F.col("end_bar") - F.col("begin_bar")) / F.col("begin_val"),
            "rel_amp": move / F.col("begin_val"),
            "amp": F.abs(move),
            "bar_cnt": F.col("end_bar") - F.col("begin_bar") + 1,
        }
    )


def best_line(points: Column, sign: Column, steep: bool) -> Column:
    """Line (x, y, slope) through one of the points, newest first, and an older one; null with fewer than two points.

    From a point, the line goes to the older point seen at the steepest (`steep`) or flattest angle that does not run
    against the direction `sign`; where there is none a steep line is level, and a flat one is not drawn. The lines met
    by going on from the point that the last one reached are the candidates, and of these the one with the smallest total
    distance to all points is taken, the newest of equals."""

    def seen_from(i: Column) -> Column:
        a = F.element_at(points, i + 1)
        rise = F.transform(F.slice(points, i + 2, F.size(points)), lambda q, k: F.struct(((q["y"] - a["y"]) / (q["x"] - a["x"]) * sign).alias("rise"), (-k if steep else k).alias("near")))
        onward = F.filter(rise, lambda r: r["rise"] > 0 if steep else r["rise"] >= 0)
        best = F.array_max(onward) if steep else F.array_min(onward)
        level = F.lit(0.0) if steep else F.lit(None).cast("double")
        reached = F.coalesce(F.abs(best["near"]), F.lit(0)) + i + 1
        return F.struct(i.alias("i"), reached.alias("reached"), a["x"].cast("double").alias("x"), a["y"].cast("double").alias("y"), (F.coalesce(best["rise"], level) * sign + 0.0).alias("slope"))

    edges = F.when(F.size(points) > 1, F.transform(F.sequence(F.lit(0), F.size(points) - 2), seen_from)).otherwise(F.array())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,reached:int,x:double,y:double,slope:double>>").alias("met"))
    walk = F.aggregate(edges, start, lambda w, e: F.when(e["i"] == w["at"], F.struct(e["reached"].alias("at"), F.concat(w["met"], F.array(e)).alias("met"))).otherwise(w))

    def with_distance(e: Column) -> Column:
        off = F.aggregate(points, F.lit(0.0), lambda t, q: t + F.abs(e["slope"] * (q["x"] - e["x"]) - (q["y"] - e["y"])))
        return F.struct((off / F.sqrt(e["slope"] * e["slope"] + 1)).alias("far"), e["i"].alias("i"), e["x"].alias("x"), e["y"].alias("y"), e["slope"].alias("slope"))

    return F.array_min(F.transform(F.filter(walk["met"], lambda e: e["slope"].isNotNull()), with_distance))


def trend_lines(strokes: DataFrame, segments: DataFrame) -> DataFrame:
    """Support and resistance line of every segment with at least three strokes, with the points where they meet
    the segment's begin and end values. A segment's strokes are few; each row carries its own short point list."""
    own = segments.filter("stroke_cnt >= 3").select(KEY, F.col("idx").alias("seg_idx"), "dir", "begin_stroke", "end_stroke", F.col("begin_val").alias("y0"), F.col("end_val").alias("y1"))
    x = strokes.join(own.drop("dir").withColumn("seg_dir", F.lit(1)), [KEY, "seg_idx"]).filter((F.col("end_stroke") - F.col("idx")) % 2 == 0)
    pts = lambda bar, val: F.sort_array(F.collect_list(F.struct(F.col(bar).alias("x"), F.col(val).alias("y"))), asc=False)
    g = x.groupBy(KEY, "seg_idx", "y0", "y1").agg(F.max_by("dir", "idx").alias("dir"), pts("begin_bar", "begin_val").alias("inner"), pts("end_bar", "end_val").alias("outer"))
    sides = g.select(
        KEY, "seg_idx", "y0", "y1", "dir",
        F.explode(F.array(F.struct(F.lit("support").alias("side"), F.col("inner").alias("p"), F.lit(True).alias("inside")), F.struct(F.lit("resistance").alias("side"), F.col("outer").alias("p"), F.lit(False).alias("inside")))).alias("s"),
    )
    sign = F.when(F.col("dir") == 1, 1.0).otherwise(-1.0)
    line = F.when(F.col("s.inside"), best_line(F.col("s.p"), sign, True)).otherwise(best_line(F.col("s.p"), sign, False))
    out = sides.select(KEY, "seg_idx", F.col("s.side").alias("side"), "y0", "y1", line.alias("l")).filter("l.x IS NOT NULL")
    at = lambda y: (F.col(y) - F.col("l.y")) / (F.col("l.slope") + 1e-7) + F.col("l.x")
    return out.select(KEY, "seg_idx", "side", "l.x", "l.y", "l.slope", at("y0").alias("x0"), "y0", at("y1").alias("x1"), "y1")


def zones_in_segments(zones: DataFrame, segments: DataFrame, strokes: DataFrame) -> DataFrame:
    """Owner segment, entry and exit stroke of every zone."""
    n = strokes.groupBy(KEY).agg((F.max("idx") + 1).alias("n_strokes"))
    owner = segments.select(KEY, F.col("idx").alias("seg_idx"), F.col("dir").alias("seg_dir"))
    exit_idx = F.col("end_line") + 1
    return (
        zones.join(owner, [KEY, "seg_idx"], "left").join(n, KEY)
        .select(KEY, "idx", "low", "high", F.when(F.col("seg_dir").isNotNull(), F.col("seg_idx")).alias("seg_idx"), (F.col("begin_line") - 1).alias("in_stroke"),
                F.when(exit_idx < F.col("n_strokes"), exit_idx).alias("out_stroke"), "is_single")
    )


def recent_buys(points: DataFrame, bars: DataFrame, days: int = 3) -> DataFrame:
    """Latest buy point of each symbol whose date lies within `days` of the symbol's last bar."""
    day = bars.select(KEY, F.col("idx").alias("bar"), "day")
    last = bars.groupBy(KEY).agg(F.max("day").alias("last_day"))
    x = points.filter("is_buy").join(day, [KEY, "bar"]).join(last, KEY).filter(F.datediff("last_day", "day") <= days)
    return x.groupBy(KEY).agg(F.max_by(F.struct("day", "types", "price"), "line").alias("p")).select(KEY, "p.day", "p.types", "p.price")


def tidy(s: Structure, points: DataFrame, seg_points: DataFrame) -> DataFrame:
    """Coordinates of everything a chart shows, in one long table."""
    box = lambda df, kind: df.select(KEY, F.lit(kind).alias("kind"), "idx", F.col("begin_bar").alias("x0"), F.col("low").alias("y0"), F.col("end_bar").alias("x1"), F.col("high").alias("y1"), "is_sure", F.lit(None).cast("string").alias("label"))
    move = lambda df, kind: df.select(KEY, F.lit(kind).alias("kind"), "idx", F.col("begin_bar").alias("x0"), F.col("begin_val").alias("y0"), F.col("end_bar").alias("x1"), F.col("end_val").alias("y1"), "is_sure", F.lit(None).cast("string").alias("label"))
    mark = lambda df, kind, tag: df.select(KEY, F.lit(kind).alias("kind"), F.col("line").alias("idx"), F.col("bar").alias("x0"), F.col("price").alias("y0"), F.col("bar").alias("x1"), F.col("price").alias("y1"), "is_sure",
                                           F.concat(F.lit(tag), F.when(F.col("is_buy"), "b").otherwise("s"), F.array_join("types", ",")).alias("label"))
    parts = [move(s.strokes, "stroke"), move(s.segments, "segment"), move(s.segsegs, "segseg"), box(s.zones, "zone"), box(s.seg_zones, "segzone"), mark(points, "point", ""), mark(seg_points, "segpoint", "※")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def structure_state(zones: DataFrame, segments: DataFrame) -> DataFrame:
    """Trend, consolidation or none per segment, and each zone's relation to the zone before it."""
    w = Window.partitionBy(KEY, "seg_idx").orderBy("idx")
    n = F.count("*").over(Window.partitionBy(KEY, "seg_idx"))
    ph, pl = F.lag("high").over(w), F.lag("low").over(w)
    pph, ppl = F.lag("peak_high").over(w), F.lag("peak_low").over(w)
    moves = (F.col("end_line") - F.col("begin_line")) / 2 + 1
    rel = (
        F.when(moves - 2 >= 5, "upgrade").when(ph.isNull(), "first").when((F.col("low") > pph) | (F.col("high") < ppl), "new")
        .when((F.col("low") > ph) | (F.col("high") < pl), "expansion").otherwise("extension")
    )
    z = zones.withColumns({"zones_in_seg": n, "relation": rel})
    state = F.when(F.col("zones_in_seg") >= 2, "trend").when(F.col("zones_in_seg") == 1, "consolidation").otherwise("none")
    seg = segments.select(KEY, F.col("idx").alias("seg_idx"), "dir")
    return seg.join(z.select(KEY, "seg_idx", F.col("idx").alias("zone_idx"), "relation", "zones_in_seg"), [KEY, "seg_idx"], "left").withColumn("state", state)


def lower_level_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Merged bars of the hourly level under each merged bar of the daily level; neighbours may share one."""
    from barflow.operators.bars import bar_end, children, roll_up
    from barflow.operators.scan import numbered
    from barflow.sources.tables import hour_bars

    hours = numbered(hour_bars(spark, sf), F.date_trunc("month", "ts"))
    days = numbered(roll_up(hours, "day"), F.date_trunc("year", "ts")).withColumn("level", F.lit("day")).withColumn("end_ts", bar_end())
    kids = children(days, hours.withColumn("end_ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")))

    def owned(bars: DataFrame, out: str) -> DataFrame:
        m = merged_bars(bars)
        return m.select(KEY, F.col("mb_idx").alias(out), F.explode(F.sequence("first_bar", "last_bar")).alias("idx"))

    up = days.join(owned(days, "parent_mb"), [KEY, "idx"]).select(KEY, F.col("end_ts").alias("parent_end"), "parent_mb")
    low = hours.join(owned(hours, "child_mb"), [KEY, "idx"]).select(KEY, "ts", "child_mb")
    return kids.join(low, [KEY, "ts"]).join(up, [KEY, "parent_end"]).select(KEY, "parent_mb", "child_mb").distinct()
