"""Segments over strokes, and segments over segments.

A segment ends where the lines running against it turn. Whether a turn can be seen from a given line depends on the lines
after it only, so it is answered for every line at once: `outcomes` folds each line's successors until they show a turn or
rule one out. Windows then point every line to the first later one that is not ruled out, and to the extremes that an
unfinished rest can reach. `chains` follows these pointers from the start of a series; it takes one step per segment.

Everything is written for an upward segment, whose turn is a top of its falling lines; for a downward one the same lines are
read with both axes turned round (h = -low, l = -high).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.columns import values
from barflow.session import cut, placed

#: lines of one direction that the first look-ahead holds; most turns show within a handful
AHEAD = 16
FIRST, SECOND, TURN, NONE = range(4)
#: symbol, pos, up, begin, end, high, low, used and the bars at both ends, as every line has them
ENDS = ["a_bar", "a_low", "a_high", "b_bar", "b_low", "b_high", "first_bar", "last_bar"]
LINE = ["symbol", "pos", "up", "begin", "end", "high", "low", "sure", "used", *ENDS]


STATE = ["phase", "low1", "high2", "low2", "last2", "peak", "gap", "real", "proof", "third_used", "all_used", "opened", "seen"]


def _fold() -> str:
    """SQL of the state after all lines of `ahead`, the lines of the segment's opposite direction after the one at (h, l).

    phase FIRST gathers lines inside the first element, SECOND those that fold into the second one, then the third decides.
    """

    def new(**values: str) -> str:
        values["all_used"] = "s.all_used AND x.used"
        return "named_struct(" + ", ".join(f"'{f}', {values.get(f, 's.' + f)}" for f in STATE) + ")"

    in_first = f"""CASE
      WHEN h >= x.h AND s.low1 <= x.l THEN {new(low1="IF(x.h = x.l AND x.h = h, s.low1, greatest(s.low1, x.l))")}
      WHEN x.h < h THEN {new(phase=f"{NONE}", seen="x.pos")}
      ELSE {new(phase=f"{SECOND}", high2="x.h", low2="x.l", last2="x.l", peak="x.pos", opened="x.pos", seen="x.pos")} END"""
    within = "s.high2 >= x.h AND s.low2 <= x.l"
    around = "s.high2 <= x.h AND s.low2 >= x.l AND NOT (s.high2 = x.h AND s.low2 > x.l)"
    folded = new(high2="greatest(s.high2, x.h)", low2="IF(x.h = x.l AND x.h = s.high2, s.low2, greatest(s.low2, x.l))", last2="x.l", peak="IF(x.h >= s.high2, x.pos, s.peak)")
    # the third line leaves the second element, or its successor does, or the lines end before that can be told
    leaves, later = "x.l < s.last2", "coalesce(x.two_l < x.l, false)"
    untold = "IF(x.two_l IS NOT NULL, NOT x.two_used OR NOT x.three, coalesce(x.one_h <= s.high2, true))"
    turned = f"({leaves} OR {later} OR {untold}) AND h < s.high2 AND x.h <= s.high2 AND x.l < s.low2"
    third = new(
        phase=f"IF({turned}, {TURN}, {NONE})", gap="h < s.low2", real=f"{leaves} OR {later} OR NOT {untold}",
        proof=f"IF(NOT ({leaves}) AND {later}, x.two_used, x.used)", third_used="x.used", seen="x.pos",
    )
    none = {"phase": f"{FIRST}", "low1": "l", "peak": "-1", "gap": "false", "real": "true", "proof": "false", "third_used": "false", "all_used": "used", "opened": "CAST(NULL AS INT)", "seen": "-1"}
    init = "named_struct(" + ", ".join(f"'{f}', {none.get(f, 'CAST(NULL AS DOUBLE)')}" for f in STATE) + ")"
    step = f"CASE WHEN s.phase >= {TURN} THEN s WHEN s.phase = {FIRST} THEN {in_first} WHEN ({within}) OR ({around}) THEN {folded} ELSE {third} END"
    return f"aggregate(ahead, {init}, (s, x) -> {step})"


def outcomes(lines: DataFrame, ahead: int) -> DataFrame:
    """`lines` with the fold's last state for a turn that starts at each line, `o`, and whether it needs lines beyond the
    look-ahead, `short`."""
    every = Window.partitionBy("symbol").orderBy("pos")
    alike = Window.partitionBy("symbol", "up").orderBy("pos")
    turned = {"h": F.expr("IF(up, -low, high)"), "l": F.expr("IF(up, -high, low)"), "_next": F.expr("IF(up, high, -low)")}
    x = lines.withColumns(turned).withColumns(
        {"one_h": F.lead("_next").over(every), "two_l": F.lead("l", 2).over(every), "two_used": F.lead("used", 2).over(every), "three": F.lead("pos", 3).over(every).isNotNull()}
    )
    one = F.struct("pos", "h", "l", "used", "one_h", "two_l", "two_used", "three")
    x = x.withColumns({"ahead": F.collect_list(one).over(alike.rowsBetween(1, ahead)), "left": F.count("*").over(alike.rowsBetween(1, ahead + 1))})
    x = x.withColumn("o", F.expr(_fold())).drop("ahead")
    return x.withColumn("short", (F.col("o.phase") < TURN) & (F.col("left") > ahead))


def pointers(lines: DataFrame, ahead: int) -> DataFrame:
    """Every line's outcome, the first line from it on that rules no turn out (`open`), the number of rulings from it on that
    rest on untold lines (`shaky`), and the last highest and lowest line end from it on (`top`, `bottom`)."""
    o = outcomes(lines, ahead)
    later = Window.partitionBy("symbol", "up").orderBy(F.desc("pos"))
    back = Window.partitionBy("symbol").orderBy("pos")
    all_ahead = Window.partitionBy("symbol").orderBy(F.desc("pos"))
    before = F.lag("end", 2).over(back)
    sign = F.when(F.col("up"), 1.0).otherwise(-1.0)
    # an end that falls short of its predecessor's is no extreme
    extreme = F.coalesce(before * sign <= F.col("end") * sign, F.lit(True))
    mark = F.when(extreme, F.struct((F.col("end") * sign).alias("v"), F.col("pos").alias("p")))
    o = o.withColumns({"mark": mark})
    return o.withColumns(
        {
            "open": F.min(F.when(F.col("o.phase") != NONE, F.col("pos"))).over(later),
            "shaky": F.sum(F.when((F.col("o.phase") == NONE) & ~F.col("o.real"), 1).otherwise(0)).over(later),
            "top": F.max(F.when(F.col("up"), F.col("mark"))).over(all_ahead)["p"],
            "bottom": F.max(F.when(~F.col("up"), F.col("mark"))).over(all_ahead)["p"],
        }
    ).drop("mark")


class MoreLines(Exception):
    """A start whose outcome lies beyond the look-ahead is needed."""


class Chain:
    """Follows the pointers of one series; `out` holds (first line, last line, up, sure, reason)."""

    def __init__(self, c: dict[str, list], left: str):
        self.c, self.left, self.n = c, left, len(c["pos"])
        self.up, self.begin, self.end = c["up"], c["begin"], c["end"]
        self.out: list[tuple[int, int, bool, bool, str]] = []

    def turns(self) -> None:
        at = 0
        while at is not None and at < self.n:
            found = self._turn_after(at) if self.out else self._first_turn(at)
            at = None
            if found:
                start, shaky = found
                last = self.c["peak"][start] - 1
                told, sure = self._told(start, shaky)
                if self.add(last, told and sure and self.c["all_used"][start]) is False or told:
                    at = last + 1

    def _seen(self, start: int | None) -> tuple[int, bool] | None:
        """(the first start from `start` on that shows a turn, whether a ruling on the way was shaky)."""
        s = self.c["open"][start] if start is not None and start < self.n else None
        if s is not None and self.c["short"][s]:
            raise MoreLines
        return (s, self.c["shaky"][start] > self.c["shaky"][s]) if s is not None and self.c["phase"][s] == TURN else None

    def _turn_after(self, at: int) -> tuple[int, bool] | None:
        return self._seen(at + 1)

    def _told(self, s: int, shaky: bool) -> tuple[bool, bool]:
        """Whether the turn at `s` is final, and whether final lines prove it: a gap asks for a turn back, and so on."""
        sure, real = True, self.c["real"][s] and not shaky
        while self.c["gap"][s]:
            back = self._seen(self.c["peak"][s] + 1)
            if back is None or not (self.c["real"][back[0]] and not back[1]):
                return False, False
            s, real = back[0], True
            sure = sure and self.c["third_used"][s]
        return real, sure and self.c["proof"][s]

    def _first_turn(self, at: int) -> tuple[int, bool] | None:
        """Without a segment before, the direction is that of the side first seen with a second element; a side that falls
        back to one element gives the direction up again."""
        c, base, want = self.c, {True: at, False: at}, None
        for side in base:
            base[side] += self.up[at] == side if at < self.n else 0

        def state(side: bool, now: int) -> tuple[int, int]:
            s = base[side]
            while s <= now and c["phase"][s] == NONE and c["seen"][s] <= now:
                s += 2
            if s <= now and c["short"][s]:
                raise MoreLines
            return s, 0 if s > now else 1 if c["opened"][s] is None or c["opened"][s] > now else 2

        for now in range(at, self.n):
            side = not self.up[now]
            fed = want in (None, side)
            s, elements = state(side, now)
            if elements > 1:
                want = side
            elif want == side:
                want = None
                base[not side] = now + 1
            if fed and elements > 1 and c["phase"][s] == TURN and c["seen"][s] <= now:
                return s, c["shaky"][base[side]] > c["shaky"][s]
            if want == side:
                base[not side] = now + 1
        return None

    def add(self, last: int, sure: bool = False, up: bool | None = None, why: str = "turn") -> bool:
        up = self.up[last] if up is None else up
        if not self.out and why == "turn" and self._two_parts(last):
            return True
        first = self.out[-1][1] + 1 if self.out else 0
        sure = sure and last - first >= 2
        if sure and (self.begin[first] > self.end[last] if up else self.begin[first] < self.end[last]):
            if not self.out:
                return False
            sure = False
        self.out.append((first, last, up, sure, why))
        return True

    def _two_parts(self, last: int) -> bool:
        """An extreme before a first segment, beyond the first line, makes two unsure segments of it."""
        sign = -1 if self.up[last] else 1
        value = lambda p: sign * self.end[p]
        fits = [p for p in range(last - 2) if self.up[p] != self.up[last] and (p < 2 or value(p) >= value(p - 2))]
        if not fits:
            return False
        far = max(fits, key=lambda p: (value(p), -p))
        edge = self.c["low" if self.up[last] else "high"]
        if far and not sign * edge[far] > sign * edge[0]:
            return False
        self.add(far, False, self.up[far], "split_first")
        self.add(last, False, None, "split_second")
        return True

    def rest(self) -> None:
        """Unsure segments up to the last line."""
        if self.out:
            self._from_last()
            if len(self.out) > 1 and self.n - 1 - self.out[-1][1] > 2 and not self.out[-1][3]:
                self.out.pop()
                self._from_last()
        elif self.n >= 3:
            if self.left == "all":
                self.add(self.n - 1, False, self.end[-1] >= self.begin[0], "first_all")
                return
            rise, fall = max(self.c["high"]) - self.begin[0], min(self.c["low"]) - self.begin[0]
            up = abs(rise) >= abs(fall)
            far = self._extreme(up, 0)
            if far is not None:
                self.add(far, False, up, "first_peak")
                self._remainder()

    def _extreme(self, up: bool, start: int) -> int | None:
        return self.c["top" if up else "bottom"][start] if start < self.n else None

    def _from_last(self) -> None:
        last = self.out[-1][1]
        if self.n - 1 - last < 3:
            return
        up = self.up[last]
        far = self._extreme(not up, last + 3)
        if self.end[-1] >= self.end[last] if up else self.end[-1] <= self.end[last]:
            # the last line went beyond the segment's end
            if far is not None:
                self.add(far, False, not up, "rest_forced")
                self.rest()
            return
        while self.left == "peak" and far is not None:
            self.add(far, False, not up, "rest_peak")
            last, up = far, self.up[far]
            far = self._extreme(not up, last + 3)
        self._remainder()

    def _remainder(self) -> None:
        last = self.out[-1][1]
        if last + 1 < self.n:
            self.add(self.n - 1 - (self.up[last] == self.up[-1]), False, None, "rest")

    # the two older rules decide by single lines; `broke` and `shape` say what each line does to its neighbours

    def breaks(self) -> None:
        peak, edge = None, lambda p: self.c["high"][p] if self.up[p] else -self.c["low"][p]
        for p in range(2, self.n):
            if peak is not None and self.up[p] == self.up[peak] and edge(p) >= edge(peak):
                peak = p
            elif edge(p) > edge(p - 2):
                if peak is None:
                    peak = p if not self.out or self.up[p] != self.out[-1][2] else None
                elif self.up[p] != self.up[peak] and p - peak > 2:
                    self.add(peak, True)
                    peak = p
        if peak is not None:
            self.add(peak)

    def one_plus_one(self) -> None:
        high, low, base = self.c["high"], self.c["low"], 0
        for p in range(2, self.n - 2):
            up, last = self.up[p], self.out[-1][1] if self.out else None
            if last is not None and (up != self.up[last] or p - last < 4):
                continue
            if low[p - 1] > high[base] if up else high[p - 1] < low[base]:
                continue
            if up:
                held = low[p + 2] > low[p] and high[p + 2] > min(high[p], high[p - 2]) and high[p] != high[p - 2]
                held = held and high[p + 2] > (high[p] if high[p] < high[p - 2] else high[p - 2])
            else:
                held = high[p + 2] < high[p] and low[p] != low[p - 2] and low[p + 2] < (low[p] if low[p] > low[p - 2] else low[p - 2])
            if held:
                self.add(p - 1, True)
                base = p
        if self.out:
            self._stretch()

    def _stretch(self) -> None:
        """The last segment runs to its furthest extreme; an extreme beyond that forces one more segment against it."""
        first, last, seg_up, _, why = self.out[-1]
        up = self.up[last]
        edge = lambda p, high: self.c["high"][p] if high else -self.c["low"][p]
        best = last
        for p in range(last + 1, self.n):
            if self.up[p] == up and edge(p, up) > edge(best, up):
                best = p
        if best != last:
            self.out[-1] = (first, best, seg_up, False, why)
        if any(edge(p, up) > edge(best, up) for p in range(best + 1, self.n)):
            against = [p for p in range(best + 3, self.n) if self.up[p] != up]
            if against:
                self.add(max(against, key=lambda p: (edge(p, not up), -p)))

    def run(self, algo: str) -> list[tuple[int, int, bool, bool, str]]:
        if self.n:
            {"chan": self.turns, "1+1": self.one_plus_one, "break": self.breaks}[algo]()
            self.rest()
        return self.out


def by_series(batches: Iterator[pa.RecordBatch], key: str = "symbol") -> Iterator[tuple[str, dict[str, list]]]:
    """(series, its columns) from batches that Spark has sorted by series; one series is held at a time."""
    name, held = None, None
    for b in batches:
        columns = {c: values(b.column(c)) for c in b.schema.names}
        keys, at = columns.pop(key), 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != name:
                if held is not None:
                    yield name, held
                name, held = keys[at], {c: [] for c in columns}
            for c, v in columns.items():
                held[c] += v[at:end]
            at = end
    if held is not None:
        yield name, held


SEGMENT = "symbol string, pos int, up boolean, begin double, end double, high double, low double, sure boolean, used boolean, " + ", ".join(f"{c} {'int' if c.endswith('bar') else 'double'}" for c in ENDS) + ", ref_a int, ref_b int, why string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def _walked(lines: DataFrame, algo: str, left: str, ahead: int) -> DataFrame:
    names, types = zip(*(f.split(" ") for f in SEGMENT.split(", ")))
    state = ["phase", "peak", "gap", "real", "proof", "third_used", "all_used", "opened", "seen"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for symbol, c in by_series(batches):
            if c["pos"] != list(range(len(c["pos"]))):
                raise ValueError(f"lines of {symbol} are not numbered from 0 without gaps")
            try:
                chain = Chain(c, left).run(algo)
            except MoreLines:
                rows.append((symbol, *[None] * (len(names) - 2), MORE))
                continue
            for n, (a, b, up, sure, why) in enumerate(chain):
                high, low = (c["b_high"][b], c["a_low"][a]) if up else (c["a_high"][a], c["b_low"][b])
                ends = [c[e][a] for e in ENDS[:3]] + [c[e][b] for e in ENDS[3:6]] + [c["first_bar"][a], c["last_bar"][b]]
                rows.append((symbol, n, up, c["begin"][a], c["end"][b], high, low, sure, sure, *ends, a, b, why))
            if len(rows) > 10_000:
                yield _batch(rows, names, types)
                rows = []
        yield _batch(rows, names, types)

    found = pointers(placed(lines), ahead)
    columns = ["symbol", "pos", "up", "begin", "end", "high", "low", *ENDS, "open", "shaky", "short", "top", "bottom", *[F.col(f"o.{s}").alias(s) for s in state]]
    # the windows leave each series in one partition, in order
    return found.select(*columns).sortWithinPartitions("symbol", "pos").mapInArrow(walk, SEGMENT)


MORE = "more"


def segments(lines: DataFrame, algo: str = "chan", left: str = "peak") -> DataFrame:
    """Segments as lines of the next level: the columns of a line, the first and last line (ref_a, ref_b) and the reason.

    Series that need more lines than the look-ahead holds are done again with eight times as many. The result is written."""
    ahead = AHEAD
    out = cut(placed(_walked(lines, algo, left, ahead)))
    more = out.filter(F.col("why") == MORE).select("symbol")
    while not more.isEmpty():
        ahead *= 8
        again = cut(placed(_walked(lines.join(more, "symbol", "left_semi"), algo, left, ahead)))
        out = out.filter(F.col("why") != MORE).unionByName(again)
        more = again.filter(F.col("why") == MORE).select("symbol")
    return out


def _batch(rows: list[tuple], names, types) -> pa.RecordBatch:
    data = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(data, types)], list(names))


def owned(lines: DataFrame, segs: DataFrame) -> DataFrame:
    """`owner`: the number of the line's segment; lines after the last one get the number of segments."""
    ends = segs.select("symbol", F.col("ref_b").alias("pos"), F.lit(1).alias("_end"))
    w = Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.join(ends, ["symbol", "pos"], "left").withColumn("owner", F.coalesce(F.count("_end").over(w), F.lit(0)).cast("int")).drop("_end")
