"""Zones: ranges that successive lines share, inside segments or across them, as one fold in the JVM.

Inside a segment only the lines running against it count, its first one never extends an older zone, and zones never reach
over its end, so segments are folded apart. The free rule takes three lines in a row wherever they overlap; there, and where
both rules are mixed, the fold runs over the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.structure.config import StructureConfig

PART = "struct<begin:int,end:int,low:double,high:double>"
ZONE = f"struct<begin:int,end:int,begin_bar:int,end_bar:int,low:double,high:double,peak_low:double,peak_high:double,sure:boolean,owner:int,parts:array<{PART}>>"
FIELDS = ["begin", "end", "begin_bar", "end_bar", "low", "high", "peak_low", "peak_high", "sure", "owner", "parts"]


def _but(s: Column, fields: list[str], **new: Column) -> Column:
    return F.struct(*[(new[f] if f in new else s[f]).alias(f) for f in fields])


def let(value: Column, fn) -> Column:
    """fn(value) with the value worked out once, however often fn names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _last(a: Column, k: int = 1) -> Column:
    return F.element_at(a, F.lit(-k))


def _front(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.size(a) - 1)


def _union(p: Column, q: Column) -> Column:
    """The later zone q becomes part of p."""
    own = lambda z: F.struct(z["begin"].alias("begin"), z["end"].alias("end"), z["low"].alias("low"), z["high"].alias("high"))
    parts = F.concat(F.when(F.size(p["parts"]) > 0, p["parts"]).otherwise(F.array(own(p))), F.array(own(q)))
    return _but(
        p, FIELDS, end=q["end"], end_bar=q["end_bar"], low=F.least(p["low"], q["low"]), high=F.greatest(p["high"], q["high"]),
        peak_low=F.least(p["peak_low"], q["peak_low"]), peak_high=F.greatest(p["peak_high"], q["peak_high"]), parts=parts,
    )


def _fused(zones: Column, conf: StructureConfig) -> Column:
    """The last zone joins its predecessors of the same segment while they are near enough."""
    if not conf.zs_combine:
        return zones

    def near(p: Column, q: Column) -> Column:
        if conf.zs_combine_mode == "zs":
            meets = (q["high"] >= p["low"]) & (p["high"] >= q["low"])
        else:
            meets = (q["peak_high"] > p["peak_low"]) & (p["peak_high"] > q["peak_low"])
        return (q["begin"] != q["end"]) & (p["owner"] == q["owner"]) & meets

    def back(s: Column, p: Column) -> Column:
        joined = F.struct(_union(p, s["cur"]).alias("cur"), s["kept"].alias("kept"), F.lit(False).alias("stop"))
        apart = F.struct(s["cur"].alias("cur"), F.concat(F.array(p), s["kept"]).alias("kept"), F.lit(True).alias("stop"))
        return F.when(~s["stop"] & near(p, s["cur"]), joined).otherwise(apart)

    def folded(zs: Column) -> Column:
        start = F.struct(_last(zs).alias("cur"), F.array().cast(f"array<{ZONE}>").alias("kept"), F.lit(False).alias("stop"))
        joined = F.aggregate(F.reverse(_front(zs)), start, back, lambda s: F.concat(s["kept"], F.array(s["cur"])))
        return F.when(F.size(zs) < 2, zs).otherwise(joined)

    return let(zones, folded)


def _meets(z: Column, high: Column, low: Column) -> Column:
    return (high > z["low"]) & (z["high"] > low)


def _tail(a: Column, k: int) -> Column:
    return F.slice(a, -F.least(F.lit(k), F.size(a)), F.lit(k))


def _made(pick: Column, sure: Column) -> Column:
    """The zone of these lines: what they share."""
    a, b = F.element_at(pick, 1), _last(pick)
    lows, highs = F.transform(pick, lambda y: y["low"]), F.transform(pick, lambda y: y["high"])
    values = {
        "begin": a["pos"], "end": b["pos"], "begin_bar": a["begin_bar"], "end_bar": b["end_bar"], "low": F.array_max(lows), "high": F.array_min(highs),
        "peak_low": F.array_min(lows), "peak_high": F.array_max(highs), "sure": sure, "owner": a["owner"], "parts": F.array().cast(f"array<{PART}>"),
    }
    return F.struct(*[values[f].alias(f) for f in FIELDS])


def _step(conf: StructureConfig):
    none = F.array().cast(f"array<{LINE}>")

    def state(zones: Column, loose: Column) -> Column:
        return F.struct(zones.alias("zones"), loose.alias("loose"))

    def collected(s: Column, x: Column, loose: Column, need: int, keep: int, free: bool) -> Column:
        """The line waits with the loose ones, or makes a zone with them."""

        def with_line(more: Column) -> Column:
            pick = _tail(more, need) if need > 1 else more
            against = ~F.coalesce(pick[0]["owner_up"] == pick[0]["up"], F.lit(False)) if free else F.lit(True)

            def decide(z: Column) -> Column:
                ok = (F.size(more) >= need) & (z["high"] > z["low"]) & (z["begin"] > 0) & against
                return F.when(ok, state(_fused(F.concat(s["zones"], F.array(z)), conf), none)).otherwise(state(s["zones"], _tail(more, keep) if keep else more))

            return let(_made(pick, x["sure"]), decide)

        return let(F.concat(loose, F.array(_but(x, LINE_FIELDS))), with_line)

    def grown(z: Column, x: Column) -> Column:
        # a zone of one line takes the range it shares with the second
        low, high = z["low"], z["high"]
        if conf.one_bi_zs:
            single = z["begin"] == z["end"]
            low, high = F.when(single, F.greatest(low, x["low"])).otherwise(low), F.when(single, F.least(high, x["high"])).otherwise(high)
        return _but(z, FIELDS, end=x["pos"], end_bar=x["end_bar"], low=low, high=high, peak_low=F.least(z["peak_low"], x["low"]), peak_high=F.greatest(z["peak_high"], x["high"]))

    def inside(s: Column, x: Column, loose: Column) -> Column:
        z = _last(s["zones"])
        joins = ~x["fresh"] & (F.size(loose) == 0) & (F.size(s["zones"]) > 0) & _meets(z, x["high"], x["low"])
        taken = state(_fused(F.concat(_front(s["zones"]), F.array(grown(z, x))), conf), loose)
        return F.when(joins, taken).otherwise(collected(s, x, loose, 1, 0, False) if conf.one_bi_zs else collected(s, x, loose, 2, 1, False))

    def free(s: Column, x: Column, loose: Column) -> Column:
        # a line extends the zone next to it only if its successor meets the zone too
        z = _last(s["zones"])
        close = (x["pos"] - z["end"] <= 1) & _meets(z, x["high"], x["low"])
        open_ = (F.size(s["zones"]) > 0) & (F.size(loose) == 0)
        taken = state(F.concat(_front(s["zones"]), F.array(grown(z, x))), loose)
        as_is = state(s["zones"], loose)
        return (
            F.when(open_ & x["next_high"].isNull(), as_is).when(open_ & close & _meets(z, x["next_high"], x["next_low"]), taken)
            .when(open_ & close, as_is).otherwise(collected(s, x, loose, 3, 2, True))
        )

    def step(s: Column, x: Column) -> Column:
        def go(loose: Column) -> Column:
            if conf.zs_algo == "normal":
                return inside(s, x, loose)
            if conf.zs_algo == "over_seg":
                return free(s, x, loose)
            return F.when(x["free"], free(s, x, loose)).otherwise(inside(s, x, loose))

        return let(F.when(x["fresh"], none).otherwise(s["loose"]), go)

    return step


LINE_FIELDS = ["pos", "low", "high", "begin_bar", "end_bar", "owner", "up", "owner_up"]
LINE = "struct<pos:int,low:double,high:double,begin_bar:int,end_bar:int,owner:int,up:boolean,owner_up:boolean>"


def zones(lines: DataFrame, segs: DataFrame, conf: StructureConfig) -> DataFrame:
    """(symbol, idx, zone fields) over `lines` with their `owner`, the number of their segment in `segs`."""
    series = Window.partitionBy("symbol").orderBy("pos")
    of = segs.select("symbol", F.col("pos").alias("owner"), F.col("up").alias("owner_up"), F.col("sure").alias("owner_sure"))
    how = conf.zs_algo
    total = Window.partitionBy("symbol")
    if how == "auto":
        # the free rule starts with the first unsure segment that has no sure one ahead of it
        before = Window.partitionBy("symbol").orderBy("owner")
        met, some = F.max("owner_sure").over(before), F.max("owner_sure").over(total)
        starts = F.when(~(F.col("owner_sure") | (some & ~met)), F.col("owner"))
        of = of.withColumn("free_from", F.min(starts).over(total))
    x = lines.join(of, ["symbol", "owner"], "left")
    x = x.withColumns({"next_high": F.lead("high").over(series), "next_low": F.lead("low").over(series)})
    has = F.max("owner_up").over(total).isNotNull()
    if how == "auto":
        edge = F.max("free_from").over(total)
        # without an edge the lines after the last segment are left alone
        x = x.withColumn("free", F.coalesce(F.col("owner") >= edge, F.lit(False))).filter(F.col("free") | F.col("owner_up").isNotNull())
    else:
        x = x.withColumn("free", F.lit(how == "over_seg"))
    if how == "normal":
        last_up = F.last("owner_up", ignorenulls=True).over(series)
        x = x.withColumn("_has", has).filter("_has").withColumn("against", F.coalesce(F.col("owner_up"), ~last_up))
    else:
        x = x.withColumn("against", F.col("owner_up"))
    x = x.filter(F.col("free") | (F.col("up") != F.col("against")))
    piece = Window.partitionBy("symbol", "owner", "free").orderBy("pos")
    fresh = F.row_number().over(piece) == 1
    if how != "normal":
        whole = Window.partitionBy("symbol", "free").orderBy("pos")
        fresh = F.when(F.col("free"), F.row_number().over(whole) == 1).otherwise(fresh)
    sure = F.when(F.col("free"), F.col("sure")).otherwise(F.coalesce("owner_sure", F.lit(False)))
    x = x.withColumns({"fresh": fresh, "sure": sure})
    item = F.struct("pos", "low", "high", F.col("a_bar").alias("begin_bar"), F.col("b_bar").alias("end_bar"), "owner", "up", "owner_up", "sure", "free", "fresh", "next_high", "next_low")
    keys = ["symbol", "owner"] if how == "normal" else ["symbol"]
    init = F.struct(F.array().cast(f"array<{ZONE}>").alias("zones"), F.array().cast(f"array<{LINE}>").alias("loose"))
    found = x.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("run")).select("symbol", F.explode(F.aggregate("run", init, _step(conf), lambda s: s["zones"])).alias("z"))
    number = F.row_number().over(Window.partitionBy("symbol").orderBy("z.begin")) - 1
    return found.withColumn("idx", number.cast("int")).select("symbol", "idx", *[F.col(f"z.{f}").alias(f) for f in FIELDS])
