"""Universe screens: features, scores, context and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.functions import labels as L
from barflow.functions import rules as R
from barflow.operators import bars as B
from barflow.operators import indicators as ind
from barflow.operators import structure as S
from barflow.operators.scan import SERIES
from barflow.operators.structure import points as P
from barflow.operators.structure.strength import with_strengths
from barflow.plans import context
from barflow.session import cut, cut_in_place
from barflow.sources import tables as T

# Names of the point columns and of the structure features that stay 0.
POINT_KINDS = ("1", "1p", "2", "2s", "3a", "3b")
ZERO_FEATURES = ("divergence_type", "bsp1_distance", "higher_tf_trend", "multi_tf_agreement", "nesting_confirmed")


def last_bar(df: DataFrame) -> DataFrame:
    """The last row of each series, found by one aggregation instead of a sort."""
    cols = [c for c in df.columns if c not in ("symbol",)]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*cols), "idx").alias("b")).select("symbol", "b.*")


def top_zones(zones: DataFrame) -> DataFrame:
    """Adds `from_top`: 1 for a symbol's highest zone."""
    return zones.withColumn("from_top", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("low"), F.desc("high"))))


def summary(s: S.Structure, points: DataFrame, bars: DataFrame, zone_pick: str = "highest", min_bars: int = 30) -> DataFrame:
    """Per symbol: price, last point, zone text, position and counts. Short series report no signal.

    `bars` may be a table of (symbol, price, n_bars) instead."""
    price = bars if "n_bars" in bars.columns else bars.groupBy("symbol").agg(F.max_by("close", "idx").alias("price"), F.count("*").alias("n_bars"))
    zones = top_zones(s.zones).groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.when(F.col("from_top") <= 2, F.struct("low", "high")))).alias("top"),
        F.max(F.struct("low", "high")).alias("highest"),
        F.max_by(F.struct("low", "high"), "idx").alias("latest"),
        F.count("*").alias("zone_cnt"),
    )
    strokes = s.strokes.groupBy("symbol").agg(F.count("*").alias("stroke_cnt"), F.max_by("is_sure", "idx").alias("tail_sure"))
    last = points.groupBy("symbol").agg(F.max_by(F.struct("is_buy", "types", "bar", "features"), "line").alias("p"))
    text = F.array_join(
        F.transform("top", lambda q: F.concat(q["low"].cast("bigint").cast("string"), F.lit("~"), q["high"].cast("bigint").cast("string"))), ","
    )
    ok = F.col("n_bars") >= min_bars
    pick = F.when(ok, F.col(zone_pick))
    out = (
        price.join(zones, "symbol", "left").join(strokes, "symbol", "left").join(last, "symbol", "left")
        .select(
            "symbol", "price", "n_bars",
            F.coalesce(F.when(ok, F.col("p.is_buy")), F.lit(False)).alias("is_buy"),
            F.coalesce(F.when(ok, F.array_join("p.types", ",")), F.lit("")).alias("types"),
            F.coalesce(F.when(ok, text), F.lit("")).alias("zs"),
            pick["low"].alias("zone_low"), pick["high"].alias("zone_high"),
            F.coalesce("stroke_cnt", F.lit(0)).alias("stroke_cnt"), F.coalesce("zone_cnt", F.lit(0)).alias("zone_cnt"),
            F.coalesce("tail_sure", F.lit(False)).alias("tail_sure"),
            F.col("p.bar").alias("point_bar"), F.element_at("p.features", "divergence_rate").alias("divergence_rate"),
        )
    )
    out = out.withColumn("position", R.position("price", "zone_low", "zone_high"))
    return out.withColumn("signal", R.signal_label())


def structure_features(s: S.Structure, points: DataFrame, bars: DataFrame, compat: bool = False, lines: DataFrame | None = None, zone_pick: str = "highest") -> DataFrame:
    """Point one-hots and stroke, zone and segment features per symbol. `bars` must carry macd.

    compat=True reproduces the known quirks: point columns are 0 and the last segment always counts as rising.
    """
    lines = with_strengths(s.strokes, bars, {"full_area", "peak"}) if lines is None else lines
    packed = F.struct("dir", "begin_val", "end_val", "begin_mb", "end_mb", "in_full_area", "in_peak")
    stroke = lines.groupBy("symbol").agg(F.max_by(packed, "idx").alias("s"))
    zone = s.zones.groupBy("symbol").agg(F.max_by(F.struct("low", "high"), "idx").alias("z"), F.count("*").alias("zn"))
    seg = s.bare_segments.groupBy("symbol").agg(F.max_by(F.struct(F.col("stroke_cnt").alias("seg_strokes"), "end_stroke"), "idx").alias("g"))
    tail = s.strokes.select("symbol", F.col("idx").alias("end_stroke"), F.col("dir").alias("seg_dir"))
    seg = seg.select("symbol", "g.*").join(tail, ["symbol", "end_stroke"], "left").drop("end_stroke")
    base = summary(s, points, bars, zone_pick)
    x = base.join(stroke, "symbol", "left").join(zone, "symbol", "left").join(seg, "symbol", "left")
    length = F.coalesce(F.abs(F.col("s.end_val") - F.col("s.begin_val")) / F.greatest(F.col("s.begin_val"), F.lit(1e-10)) * 100, F.lit(0.0))
    bars_in = F.coalesce(F.col("s.end_mb") - F.col("s.begin_mb") + 1, F.lit(0)).cast("double")
    width = F.coalesce((F.col("z.high") - F.col("z.low")) / F.greatest("price", F.lit(1e-10)) * 100, F.lit(0.0))
    kinds = F.split("types", ",")
    hot = {
        f"bsp_{side}_type{k}": F.when((F.col("is_buy") == (side == "buy")) & F.array_contains(kinds, k) & F.lit(not compat), 1.0).otherwise(0.0)
        for side in ("buy", "sell") for k in POINT_KINDS
    }
    return x.withColumns(
        {
            **hot,
            "bi_slope": F.when(bars_in > 0, length / bars_in).otherwise(0.0),
            "bi_strength": length,
            "bi_len_klu": bars_in,
            "bi_macd_area": F.coalesce("s.in_full_area", F.lit(0.0)),
            "bi_macd_peak": F.coalesce("s.in_peak", F.lit(0.0)),
            "zs_count": F.coalesce("zn", F.lit(0)) / 3.0,
            "zs_width_norm": width,
            "zs_peak_range_norm": width,
            "zs_breakout_dir": F.when(F.col("price") > F.col("z.high"), 1.0).when(F.col("price") < F.col("z.low"), -1.0).otherwise(0.0),
            "seg_amp": F.when(F.col("seg_strokes").isNotNull(), 1.0).otherwise(0.0),
            "seg_bi_cnt": F.coalesce("seg_strokes", F.lit(0)).cast("double"),
            "seg_is_up": F.when(F.lit(compat) | (F.col("seg_dir") == 1), 1.0).otherwise(0.0),
            "divergence_ratio": F.coalesce("divergence_rate", F.lit(0.0)),
            **{f: F.lit(0.0) for f in ZERO_FEATURES},
        }
    ).drop("s", "z", "zn", "seg_dir", "seg_strokes", "divergence_rate")


def quick_rank(spark: SparkSession, sf: str, top: int = 15) -> DataFrame:
    """Rank by rule score, volume score and a neutral sector, from one pass over the bars."""
    b = ind.price_features(T.walk_bars(spark, sf), last=ind.REACH).withColumns(ind.volume_price(SERIES))
    x = last_bar(b).withColumn("zs_breakout_dir", F.lit(0.0))
    x = x.withColumn("score", R.feature_score()).withColumn("vol_signal", R.volume_signal(n=F.col("idx") + 1))
    x = x.withColumns({"vol_score": R.volume_score(), "sector_score": F.lit(50)}).withColumn("final_score", R.blend())
    return (
        x.select("symbol", "day", F.round("close", 2).alias("price"), "score", "vol_signal", "vol_score", "final_score")
        .orderBy(F.desc("final_score"), "symbol")
        .limit(top)
    )


def scored(bars: DataFrame, min_score: int = 0, conf: S.StructureConfig | None = None, zone_pick: str = "highest") -> DataFrame:
    """Structure, features at the last bar and rule score of every series. `bars` is read several times."""
    s = S.build(bars, conf or S.StructureConfig.from_dict(S.config.SCREEN))
    lines = cut(P.stroke_lines(s, ind.macd(bars), {"full_area", "peak"}))
    points = cut(P.stroke_points(s, lines=lines))
    struct = structure_features(s, points, bars, lines=lines, zone_pick=zone_pick)
    feats = last_bar(ind.price_features(bars.withColumn("year_chg", ind.year_change(SERIES)), last=ind.REACH).withColumns(ind.volume_price(SERIES)))
    drop = list((set(feats.columns) & set(struct.columns)) - {"symbol"})
    x = feats.drop(*drop).join(struct, "symbol")
    buys = sum((F.col(f"bsp_buy_type{k}") for k in POINT_KINDS), F.lit(0.0)) > 0
    sells = sum((F.col(f"bsp_sell_type{k}") for k in POINT_KINDS), F.lit(0.0)) > 0
    third = (F.col("bsp_buy_type3a") > 0) | (F.col("bsp_sell_type3a") > 0)
    second = (F.col("bsp_buy_type2") + F.col("bsp_buy_type2s") + F.col("bsp_sell_type2") + F.col("bsp_sell_type2s")) > 0
    return x.withColumn("xgb_score", R.feature_score(buys, sells, third, second)).filter(F.col("xgb_score") >= min_score)


def second_scan(spark: SparkSession, sf: str, last: int = 250, least: int = 50) -> DataFrame:
    """The second market: its last `last` bars without volume, the latest zone, no penalty and no volume or sector part.

    Series of fewer than `least` bars are left out. side: buy where the newest point is one, sell where the label says so."""
    bars = B.last_n(T.second_bars(spark, sf), last)
    first = Window.partitionBy("symbol")
    bars = bars.withColumn("idx", (F.col("idx") - F.min("idx").over(first)).cast("int")).withColumn("_n", F.count("*").over(first))
    bars = cut_in_place(bars.filter(F.col("_n") >= least).drop("_n").withColumn("volume", F.lit(1.0)))
    x = scored(bars, zone_pick="latest")
    side = F.when(F.col("is_buy"), "buy").when(F.startswith("signal", F.lit("Sell")), "sell").otherwise("hold")
    inside = F.coalesce(F.col("position") == L.INSIDE, F.lit(False))
    zs = F.concat(F.col("zone_low").cast("bigint").cast("string"), F.lit("~"), F.col("zone_high").cast("bigint").cast("string"))
    return x.select("symbol", "signal", "price", F.col("xgb_score").alias("score"), "year_chg", F.coalesce(zs, F.lit("")).alias("zs"), "position", side.alias("side"), inside.alias("in_zone"))


def second_tops(scan: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` buys and sells of the second market in the order of its list."""
    w = Window.partitionBy("side").orderBy("symbol")
    return scan.filter(F.col("side").isin("buy", "sell")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)


def full_scan(spark: SparkSession, sf: str, min_score: int = 0, conf: S.StructureConfig | None = None) -> DataFrame:
    """The whole screen: structure, features, rule score, volume and sector context, penalty and blend."""
    bars = cut_in_place(T.walk_bars(spark, sf))  # read by the fold, the strengths, the features and the quotes
    x = scored(bars, min_score, conf)
    x = x.withColumn("ext", R.extended()).withColumn("xgb_score", R.penalised("xgb_score"))
    x = x.withColumn("vol_signal", R.volume_signal(n=F.col("n_bars"))).withColumn("vol_score", R.volume_score())
    uni = T.universe(spark, sf)
    q = T.quotes(bars)
    heat = context.sector_heat(q, uni)
    x = (
        x.join(q.select("symbol", "change_pct"), "symbol", "left")
        .join(uni, "symbol", "left")
        .join(heat, "sector", "left")
        .withColumns(context.sector_signal())
        .withColumn("score", R.blend("xgb_score"))
        .withColumns(R.trade_levels())
    )
    return x


def rank_by_score(df: DataFrame, score: str = "score", key: str = "symbol", out: str = "rank") -> DataFrame:
    """Global rank by (score descending, key) without one global sort: a range partitioning puts rows in order, they are
    numbered inside their partition, and a table of one row per partition gives each partition its offset."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the written rows fix which partition each belongs to
    x = cut(df.repartitionByRange(n, F.desc(score), F.col(key)).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = x.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_part").orderBy(F.desc(score), key)
    return (
        x.join(offs, "_part")
        .withColumn(out, (F.col("_off") + F.row_number().over(inner)).cast("int"))
        .drop("_part", "_off")
    )


def ranked(scan: DataFrame) -> DataFrame:
    """The 14 report columns with rank and highlight class."""
    warn = F.when(F.col("ext"), L.WARN_EXTENDED).otherwise("")
    reason = F.concat_ws("|", "position", F.when(F.col("types") == "", "-").otherwise(F.regexp_replace("types", ",", "/")), F.when(F.col("zs") == "", "-").otherwise(F.col("zs")), "vol_signal", warn)
    return rank_by_score(scan).select(
        "rank", F.col("symbol").alias("code"), F.coalesce("name", F.lit("?")).alias("name"), "score", "xgb_score",
        "price", "change_pct", F.col("signal").alias("suggestion"), "vol_signal", F.coalesce("sector", F.lit("?")).alias("sector"), "sector_signal",
        warn.alias("warning"), reason.alias("reason"),
        F.when(F.col("score") >= 75, "green").when(F.col("ext"), "yellow").otherwise("").alias("highlight"),
    )
