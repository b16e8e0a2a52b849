"""Structure tables: bars in, merged bars / strokes / segments / zones out.

Bars are hash-partitioned by series and sorted by Spark (spilling as needed); a fold then walks each partition
in one pass and holds the state of the current series only. Bars of one series are unique per level and time,
so the longest series is bounded by the calendar at its level, not by the amount of raw data.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.columns import values
from barflow.operators.structure.config import StructureConfig
from barflow.operators.structure.kernel import StrokeFold
from barflow.operators.structure.segments import ENDS, owned, segments
from barflow.operators.structure.zones import zones
from barflow.session import cut, in_place, placed

BATCH = 20000

MERGED = [
    ("symbol", "string"), ("mb_idx", "int"), ("first_bar", "int"), ("last_bar", "int"), ("high", "double"),
    ("low", "double"), ("dir", "int"), ("fx", "int"), ("hi_bar", "int"), ("lo_bar", "int"), ("max_high", "double"),
    ("min_low", "double"), ("n_bars", "int"),
]
# One row per stroke, segment, segment of segments and zone; columns that do not apply are null.
LINES = [
    ("symbol", "string"), ("kind", "string"), ("idx", "int"), ("dir", "int"), ("is_sure", "boolean"),
    ("used_sure", "boolean"), ("begin_ref", "int"), ("end_ref", "int"), ("begin_bar", "int"), ("end_bar", "int"),
    ("begin_val", "double"), ("end_val", "double"), ("high", "double"), ("low", "double"), ("first_bar", "int"),
    ("last_bar", "int"), ("owner", "int"), ("peak_high", "double"), ("peak_low", "double"), ("reason", "string"),
    ("n_lines", "int"), ("parts", "array<struct<begin:int,end:int,low:double,high:double>>"),
]
STROKES = [
    ("symbol", "string"), ("pos", "int"), ("up", "boolean"), ("begin", "double"), ("end", "double"), ("high", "double"), ("low", "double"),
    ("sure", "boolean"), ("used", "boolean"), *((c, "int" if c.endswith("bar") else "double") for c in ENDS), ("ref_a", "int"), ("ref_b", "int"),
]
ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def ddl(cols: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in cols)


def emit(cols: list[tuple[str, str]], rows: list[tuple]) -> pa.RecordBatch:
    data = list(zip(*rows)) if rows else [()] * len(cols)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(data, cols)], [n for n, _ in cols])


def series(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, float, float]]:
    for b in batches:
        yield from zip(*(values(b.column(c)) for c in ("symbol", "idx", "high", "low")))


def _merged_rows(symbol: str, fold: StrokeFold) -> list[tuple]:
    rows = [
        (symbol, m.pos, m.first, m.last, m.high, m.low, m.dir, m.fx, m.hi_bar, m.lo_bar, m.top, m.bottom, m.n)
        for m in fold.done
    ]
    fold.done = []
    return rows


def _fold(conf: StructureConfig, merged: bool):
    cols = MERGED if merged else STROKES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, fold, out = None, None, []

        def close() -> None:
            if fold is not None:
                out.extend(_merged_rows(symbol, fold) if merged else [(symbol, *s) for s in fold.strokes()])

        for sym, idx, high, low in series(batches):
            if sym != symbol:
                close()
                symbol, fold = sym, StrokeFold(conf, keep_merged=merged)
            fold.push(idx, high, low)
            if merged and len(fold.done) > BATCH:
                # a merged bar is final once two later ones exist
                tail = fold.done[-2:]
                fold.done = fold.done[:-2]
                out.extend(_merged_rows(symbol, fold))
                fold.done = tail
            if len(out) >= BATCH:
                yield emit(cols, out)
                out.clear()
        close()
        yield emit(cols, out)

    return run


def sorted_bars(bars: DataFrame) -> DataFrame:
    """Four columns, every series in its place: bars that were written there are not moved."""
    four = bars.select("symbol", F.col("idx").cast("int").alias("idx"), F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"))
    return placed(four).sortWithinPartitions("symbol", "idx")


def merged_bars(bars: DataFrame, conf: StructureConfig | None = None) -> DataFrame:
    return sorted_bars(bars).mapInArrow(_fold(conf or StructureConfig(), merged=True), ddl(MERGED))


@dataclass
class Structure:
    """The tables of one run. `bars` keeps the numbered bars the structure was built from."""

    bars: DataFrame
    lines: DataFrame
    conf: StructureConfig
    segment_lines: DataFrame

    @functools.cached_property
    def upper(self) -> DataFrame:
        """The level above: segments with their owners, segments of segments and zones of segments, built when first asked for."""
        with in_place(self.segment_lines.sparkSession):
            return cut(upper_lines(self.segment_lines, self.conf))

    def _kind(self, kind: str) -> DataFrame:
        return (self.lines if kind in ("stroke", "bare_segment", "zone") else self.upper).filter(F.col("kind") == kind)

    @property
    def strokes(self) -> DataFrame:
        return self._kind("stroke").select(
            "symbol", "idx", "dir", "is_sure", "used_sure", F.col("begin_ref").alias("begin_mb"),
            F.col("end_ref").alias("end_mb"), "begin_bar", "end_bar", "begin_val", "end_val", "high", "low",
            "first_bar", "last_bar", F.col("owner").alias("seg_idx"),
        )

    @property
    def segments(self) -> DataFrame:
        return self._segments("segment")

    @property
    def bare_segments(self) -> DataFrame:
        """Segments without the level above them: seg_idx is null."""
        return self._segments("bare_segment")

    def _segments(self, kind: str) -> DataFrame:
        return self._kind(kind).select(
            "symbol", "idx", "dir", "is_sure", F.col("begin_ref").alias("begin_stroke"),
            F.col("end_ref").alias("end_stroke"), "begin_bar", "end_bar", "begin_val", "end_val", "high", "low",
            F.col("owner").alias("seg_idx"), "reason", F.col("n_lines").alias("stroke_cnt"),
        )

    @property
    def segsegs(self) -> DataFrame:
        return self._kind("segseg").select(
            "symbol", "idx", "dir", "is_sure", F.col("begin_ref").alias("begin_seg"), F.col("end_ref").alias("end_seg"),
            "begin_bar", "end_bar", "begin_val", "end_val", "high", "low", F.col("n_lines").alias("seg_cnt"),
        )

    def _zones(self, kind: str) -> DataFrame:
        return self._kind(kind).select(
            "symbol", "idx", "is_sure", F.col("begin_ref").alias("begin_line"), F.col("end_ref").alias("end_line"),
            "begin_bar", "end_bar", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("mid"), "peak_low",
            "peak_high", F.col("owner").alias("seg_idx"), F.col("parts").alias("sub_zones"),
            (F.col("begin_ref") == F.col("end_ref")).alias("is_single"),
        )

    @property
    def zones(self) -> DataFrame:
        return self._zones("zone")

    @property
    def seg_zones(self) -> DataFrame:
        return self._zones("segzone")


def stroke_lines(bars: DataFrame, conf: StructureConfig) -> DataFrame:
    return sorted_bars(bars).mapInArrow(_fold(conf, merged=False), ddl(STROKES))


def _as_rows(kind: str, reason: bool) -> list[Column]:
    n = (F.col("ref_b") - F.col("ref_a") + 1) if reason else F.lit(None)
    given = {
        "kind": F.lit(kind), "idx": F.col("pos"), "dir": F.when(F.col("up"), 1).otherwise(-1), "is_sure": F.col("sure"), "used_sure": F.col("used"), "begin_ref": F.col("ref_a"),
        "end_ref": F.col("ref_b"), "begin_bar": F.col("a_bar"), "end_bar": F.col("b_bar"), "begin_val": F.col("begin"), "end_val": F.col("end"),
        "reason": F.col("why") if reason else F.lit(None), "n_lines": n,
    }
    same = {c: F.col(c) for c in ("symbol", "high", "low", "first_bar", "last_bar", "owner")}
    return _row(given | same)


def _zone_rows(x: DataFrame, kind: str) -> DataFrame:
    given = {"kind": F.lit(kind), "is_sure": F.col("sure"), "begin_ref": F.col("begin"), "end_ref": F.col("end"), "n_lines": F.col("end") - F.col("begin") + 1}
    return x.select(*_row(given | {c: F.col(c) for c in ("symbol", "idx", "begin_bar", "end_bar", "low", "high", "peak_low", "peak_high", "owner", "parts")}))


def _row(given: dict) -> list[Column]:
    return [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in LINES]


def upper_lines(segs: DataFrame, conf: StructureConfig) -> DataFrame:
    grand = segments(segs, conf.seg_algo, conf.left_seg_method)
    own = owned(segs, grand)
    parts = [
        own.select(*_as_rows("segment", True)),
        grand.withColumns({"owner": F.lit(0), "first_bar": F.col("a_bar"), "last_bar": F.col("b_bar")}).select(*_as_rows("segseg", True)),
        _zone_rows(zones(own, grand, conf), "segzone"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def of_strokes(bars: DataFrame, strokes: DataFrame, conf: StructureConfig) -> Structure:
    """Segments and zones over `strokes`. The tables are a small fraction of the bars and are read by many branches, so they
    are written to the checkpoint folder, every series in its place."""
    with in_place(bars.sparkSession):
        strokes = cut(placed(strokes))
        segs = segments(strokes, conf.seg_algo, conf.left_seg_method)
        own = owned(strokes, segs)
        bare = segs.withColumn("owner", F.lit(None).cast("int")).select(*_as_rows("bare_segment", True))
        lines = own.select(*_as_rows("stroke", False)).unionByName(bare).unionByName(_zone_rows(zones(own, segs, conf), "zone"))
        return Structure(bars, cut(lines), conf, segs)


def build(bars: DataFrame, conf: StructureConfig | None = None) -> Structure:
    """Strokes by the fold, the rest by Spark steps."""
    conf = conf or StructureConfig()
    return of_strokes(bars, stroke_lines(bars, conf), conf)


def fractals(merged: DataFrame) -> DataFrame:
    """Fractal of every merged bar from its two neighbours, as plain windows over the merged table."""
    w = Window.partitionBy("symbol").orderBy("mb_idx")
    ph, pl, nh, nl = F.lag("high").over(w), F.lag("low").over(w), F.lead("high").over(w), F.lead("low").over(w)
    top = (ph < F.col("high")) & (nh < F.col("high")) & (pl < F.col("low")) & (nl < F.col("low"))
    bottom = (ph > F.col("high")) & (nh > F.col("high")) & (pl > F.col("low")) & (nl > F.col("low"))
    return merged.withColumn("fractal", F.when(top, "top").when(bottom, "bottom").otherwise("none"))


def gap_to_next(merged: DataFrame) -> DataFrame:
    """Gap between the raw bars of a merged bar and of the next one; touching counts as overlap."""
    w = Window.partitionBy("symbol").orderBy("mb_idx")
    nh, nl = F.lead("max_high").over(w), F.lead("min_low").over(w)
    return merged.withColumn("gap", F.coalesce((nh < F.col("min_low")) | (nl > F.col("max_high")), F.lit(False)))
