"""Stroke strengths. Bars and strokes meet by an equi-join on the bar number, never by a range condition:
each stroke lists its bars, and neighbouring strokes share only the bars of their common merged bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-7
NEEDS = {"area": "macd", "peak": "macd", "full_area": "macd", "diff": "macd", "rsi": "rsi_w", "amount": "turnover",
         "amount_avg": "turnover", "volumn": "volume", "volumn_avg": "volume", "turnrate_avg": "turnover_rate"}


def bars_of_lines(lines: DataFrame, bars: DataFrame, cols: list[str]) -> DataFrame:
    """One row per (stroke, bar of its merged bars)."""
    spread = lines.select(
        "symbol", F.col("idx").alias("line"), "dir", "begin_bar", "end_bar",
        F.explode(F.sequence("first_bar", "last_bar")).alias("idx"),
    )
    return spread.join(bars.select("symbol", "idx", *cols), ["symbol", "idx"])


def _contiguous(x: DataFrame, start: str, backwards: bool) -> DataFrame:
    """Sum of |macd| from the start bar while the sign stays that of the start bar."""
    order = F.desc("idx") if backwards else F.asc("idx")
    w = Window.partitionBy("symbol", "line").orderBy(order)
    part = x.filter(F.col("idx") <= F.col(start) if backwards else F.col("idx") >= F.col(start))
    same = F.col("macd") * F.first("macd").over(w) > 0
    part = part.withColumn("broken", F.max((~same).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    name = "out_area" if backwards else "in_area"
    return part.groupBy("symbol", "line").agg(
        (F.lit(FLOOR) + F.sum(F.when(F.col("broken") == 0, F.abs("macd")).otherwise(0.0))).alias(name)
    )


def with_strengths(lines: DataFrame, bars: DataFrame | None, algos: set[str]) -> DataFrame:
    """Adds `in_<algo>` and `out_<algo>`; only `area` differs between entry and exit."""
    n = F.col("end_bar") - F.col("begin_bar") + 1
    spread = F.col("high") - F.col("low")
    simple: dict[str, Column] = {
        "slope": spread / F.col("high") / n,
        "amp": spread / F.when(F.col("dir") == 1, F.col("low")).otherwise(F.col("high")),
    }
    out = lines
    for a in algos & set(simple):
        out = out.withColumns({f"in_{a}": simple[a], f"out_{a}": simple[a]})
    heavy = algos - set(simple)
    if not heavy:
        return out
    cols = sorted({NEEDS[a] for a in heavy})
    x = bars_of_lines(lines, bars, cols)
    inside = (F.col("idx") >= F.col("begin_bar")) & (F.col("idx") <= F.col("end_bar"))
    hist = F.col("macd") if "macd" in cols else None
    aggs: list[Column] = []
    for a in sorted(heavy - {"area"}):
        if a == "peak":
            v = F.greatest(F.lit(FLOOR), F.max(F.when(hist * F.col("dir") > 0, F.abs(hist))))
        elif a == "full_area":
            v = F.lit(FLOOR) + F.sum(F.when(inside & (hist * F.col("dir") > 0), F.abs(hist)).otherwise(0.0))
        elif a == "diff":
            v = F.max(hist) - F.min(hist)
        elif a == "rsi":
            v = F.when(F.first("dir") == -1, 10000.0 / (F.min("rsi_w") + FLOOR)).otherwise(F.max("rsi_w"))
        else:
            c = F.col(NEEDS[a])
            total = F.when(F.max(c.isNull()), 0.0).otherwise(F.sum(c))
            v = total / (F.first("end_bar") - F.first("begin_bar") + 1) if a.endswith("_avg") else total
        aggs += [v.alias(f"in_{a}"), v.alias(f"out_{a}")]
    if aggs:
        s = x.groupBy("symbol", "line").agg(*aggs).withColumnRenamed("line", "idx")
        out = out.join(s, ["symbol", "idx"], "left")
    if "area" in heavy:
        for part in (_contiguous(x, "begin_bar", False), _contiguous(x, "end_bar", True)):
            out = out.join(part.withColumnRenamed("line", "idx"), ["symbol", "idx"], "left")
    return out
