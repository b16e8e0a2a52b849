"""The sequential steps: inclusion merge and strokes of one ordered series.

These rules depend on the previous decision, so they are folds. A fold sees the bars of a series one by one, in
order, from a Spark-sorted partition; it keeps the merged bars since the last stroke end, and the strokes.
Everything that can be said with joins and windows afterwards (segments, zones, attributes, points) is left to Spark.
"""

from __future__ import annotations

from typing import NamedTuple

UP, DOWN, FLAT = 1, -1, 0


class Stroke(NamedTuple):
    """A stroke, the raw bars at its ends with their ranges, its first and last bar, and its first and last merged bar."""

    pos: int
    up: bool
    begin: float
    end: float
    high: float
    low: float
    sure: bool
    used: bool
    a_bar: int
    a_low: float
    a_high: float
    b_bar: int
    b_low: float
    b_high: float
    first_bar: int
    last_bar: int
    ref_a: int
    ref_b: int


class Merged:
    """A run of bars folded into one range. `hi_bar` and `lo_bar` are the last members touching the range."""

    __slots__ = ("pos", "first", "last", "high", "low", "dir", "fx", "hi_bar", "lo_bar", "top", "bottom", "n",
                 "hi_low", "lo_high")

    def __init__(self, pos: int, bar: int, high: float, low: float, direction: int):
        self.pos, self.first, self.last, self.n = pos, bar, bar, 1
        self.high = self.top = high
        self.low = self.bottom = low
        self.dir, self.fx = direction, FLAT
        self.hi_bar = self.lo_bar = bar
        self.hi_low, self.lo_high = low, high

    def absorb(self, bar: int, high: float, low: float) -> None:
        up = self.dir == UP
        if not (high == low and (high == self.high if up else low == self.low)):
            if (high > self.high) == up and high != self.high:
                self.high = high
            if (low > self.low) == up and low != self.low:
                self.low = low
        if high == self.high:
            self.hi_bar, self.hi_low = bar, low
        if low == self.low:
            self.lo_bar, self.lo_high = bar, high
        self.last = bar
        self.n += 1
        if high > self.top:
            self.top = high
        if low < self.bottom:
            self.bottom = low


    def same(self, other: "Merged") -> bool:
        return self.last == other.last and self.first == other.first and all(getattr(self, f) == getattr(other, f) for f in Merged.__slots__[3:])


def as_stroke(n: int, p: Merged, q: Merged, sure: bool, used: bool, shift: int = 0) -> Stroke:
    """Stroke `n` from p to q; `shift` is added to the numbers of merged bars."""
    up = p.fx == DOWN
    begin, end = (p.low, q.high) if up else (p.high, q.low)
    a = (p.lo_bar, p.low, p.lo_high) if up else (p.hi_bar, p.hi_low, p.high)
    b = (q.hi_bar, q.hi_low, q.high) if up else (q.lo_bar, q.low, q.lo_high)
    return Stroke(n, up, begin, end, max(begin, end), min(begin, end), sure, used, *a, *b, p.first, q.last, p.pos + shift, q.pos + shift)


class StrokeFold:
    """Bars in, merged bars and strokes out."""

    def __init__(self, conf, keep_merged: bool = False):
        self.conf = conf
        self.win: list[Merged] = []  # merged bars from one before the earliest still needed
        self.done: list[Merged] | None = [] if keep_merged else None
        self.ends: list[tuple[Merged, Merged, bool, bool]] = []  # begin, end, sure, used
        self.free: list[Merged] = []
        self.count = 0

    # -- merging --

    def push(self, bar: int, high: float, low: float) -> None:
        win = self.win
        if not win:
            self._open(bar, high, low, UP)
            return
        mid = win[-1]
        # a range that moves away opens a merged bar; one that contains the other, or lies in it, is taken in
        if mid.high > high and mid.low > low:
            rel = DOWN
        elif mid.high < high and mid.low < low:
            rel = UP
        else:
            mid.absorb(bar, high, low)
            return
        self._open(bar, high, low, rel)
        # bars taken in only carry a merged bar on in its direction, so it still says how the bar before it was left
        if mid.dir != rel and len(win) >= 3:
            mid.fx = mid.dir
            self._fractal(mid)
            self._forget()

    def _open(self, bar, high, low, direction) -> None:
        m = Merged(self.count, bar, high, low, direction)
        self.count += 1
        self.win.append(m)
        if self.done is not None:
            self.done.append(m)

    def _forget(self) -> None:
        """Drop merged bars before the last stroke end; swallowing strokes may look back further."""
        if not self.conf.bi_allow_sub_peak:
            return
        keep = self.ends[-1][1] if self.ends else self.free[0]
        drop = keep.pos - 1 - self.win[0].pos
        if drop > 64:
            del self.win[:drop]

    def _at(self, pos: int) -> Merged:
        return self.win[pos - self.win[0].pos]

    # -- strokes --

    def _fractal(self, m: Merged) -> None:
        if not self.ends:
            for f in self.free:
                if f.fx != m.fx and self._joins(f, m):
                    self.ends.append((f, m, True, True))
                    return
            self.free.append(m)
            return
        end = self.ends[-1][1]
        if m.fx == end.fx:
            self._extend(m)
        elif self._joins(end, m):
            self.ends.append((end, m, True, True))
        else:
            self._lower_peak(m, virtual=False)

    def _extend(self, m: Merged) -> bool:
        begin, end, *_ = self.ends[-1]
        if m.high >= end.high if begin.fx == DOWN else m.low <= end.low:
            self.ends[-1] = (begin, m, True, True)
            return True
        return False

    def _joins(self, a: Merged, b: Merged, virtual: bool = False) -> bool:
        c = self.conf
        if c.bi_algo != "fx" and not self._span_ok(a, b):
            return False
        if not self._ends_apart(a, b, virtual):
            return False
        return not c.bi_end_is_peak or self._is_peak(a, b)

    def _between(self, a: Merged, b: Merged) -> list[Merged]:
        base = self.win[0].pos
        return self.win[a.pos + 1 - base : b.pos - base]

    def _span_ok(self, a: Merged, b: Merged) -> bool:
        span = b.pos - a.pos
        if self.conf.gap_as_kl and span < 4:
            chain = [a, *self._between(a, b), b]
            span += sum(q.top < p.bottom or q.bottom > p.top for p, q in zip(chain, chain[1:]))
        if self.conf.bi_strict:
            return span >= 4
        inner = self._between(a, b) or [b]
        if inner[-1] is self.win[-1]:
            return False
        return span >= 3 and sum(m.n for m in inner) >= 3

    def _ends_apart(self, a: Merged, b: Merged, virtual: bool) -> bool:
        """The end fractals must lie apart; how many neighbours count depends on the check mode."""
        if virtual and b.dir == a.fx:
            return False
        how = self.conf.bi_fx_check
        near_b, near_a = [b], [a]
        if how != "loss":
            near_b.append(self._at(b.pos - 1))
            near_a.append(self._at(a.pos + 1))
        if how in ("strict", "totally"):
            near_a.append(self._at(a.pos - 1))
            if not virtual:
                near_b.append(self._at(b.pos + 1))
        if a.fx == UP:
            reach = max(m.high for m in near_b)
            return a.low > reach if how == "totally" else a.high > reach and b.low < min(m.low for m in near_a)
        reach = min(m.low for m in near_b)
        return a.high < reach if how == "totally" else a.low < reach and b.high > max(m.high for m in near_a)

    def _is_peak(self, a: Merged, b: Merged) -> bool:
        inner = self._between(a, b)
        if a.fx == DOWN:
            return all(m.high <= b.high for m in inner)
        return all(m.low >= b.low for m in inner)

    def _lower_peak(self, m: Merged, virtual: bool) -> bool:
        """With sub-peaks forbidden, a new extreme beyond the last stroke's begin swallows that stroke."""
        if self.conf.bi_allow_sub_peak or len(self.ends) < 2:
            return False
        begin, end, *_ = self.ends[-1]
        before = self.ends[-2]
        up = begin.fx == DOWN
        if (m.low > begin.low) if up else (m.high < begin.high):
            return False
        if not self._is_peak(before[0], m):
            return False
        if (end.high > before[0].high) if up else (end.low < before[0].low):
            return False
        prev_up = before[0].fx == DOWN
        fits = (m.dir if virtual else m.fx) == (UP if prev_up else DOWN)
        better = m.high >= before[1].high if prev_up else m.low <= before[1].low
        if not (fits and better):
            return False
        self.ends.pop()
        self.ends[-1] = (before[0], m, not virtual, True)
        return True

    def _tail(self) -> list[tuple[Merged, Merged, bool, bool]]:
        """Strokes with the unconfirmed last one: an extension, or a new stroke towards a late merged bar."""
        if not self.ends:
            return []
        saved = list(self.ends)
        begin, end, *_ = saved[-1]
        last = self.win[-1]
        if last.pos != end.pos:
            if (last.high >= end.high) if begin.fx == DOWN else (last.low <= end.low):
                self.ends[-1] = (begin, last, False, True)
            else:
                for m in reversed(self.win[end.pos + 1 - self.win[0].pos :]):
                    if self._joins(end, m, virtual=True):
                        self.ends.append((end, m, False, False))
                        break
                    if self._lower_peak(m, virtual=True):
                        break
        out, self.ends = self.ends, saved
        return out

    def strokes(self) -> list[Stroke]:
        return [as_stroke(n, *e) for n, e in enumerate(self._tail())]

    def settle(self) -> int:
        """Forget the strokes that no later bar can change, and return how many they were."""
        n = len(self.ends) - 2 if self.conf.bi_allow_sub_peak else 0
        del self.ends[: max(n, 0)]
        return max(n, 0)

    def meets(self, other: "StrokeFold") -> bool:
        """Whether all later bars do to both folds the same: the last stroke and the merged bars from its end's predecessor on
        agree in everything but their numbers. Where sub-peaks are forbidden, older strokes count too, so never."""
        if not (self.ends and other.ends and self.conf.bi_allow_sub_peak):
            return False
        (a, b, *how), (c, d, *other_how) = self.ends[-1], other.ends[-1]
        if b.first != d.first or a.first != c.first or how != other_how or b.pos - d.pos != a.pos - c.pos or not a.same(c):
            return False
        mine, its = self.win[b.pos - 1 - self.win[0].pos :], other.win[d.pos - 1 - other.win[0].pos :]
        return len(mine) == len(its) and all(x.same(y) for x, y in zip(mine, its))

    # -- state as plain rows --

    def dump(self) -> tuple[list[tuple], list[tuple], list[int]]:
        """(merged bars still needed, the last one telling whether a window holds it; last strokes; fractals before a first stroke)."""
        needed = {m.pos: m for m in (*(x for e in self.ends for x in e[:2]), *self.free, *self.win)}
        inside = {m.pos for m in self.win}
        rows = [(*(getattr(m, f) for f in Merged.__slots__), p in inside) for p, m in sorted(needed.items())]
        return rows, [(a.pos, b.pos, sure, used) for a, b, sure, used in self.ends], [m.pos for m in self.free]

    @classmethod
    def load(cls, conf, merged: list[tuple], ends: list[tuple], free: list[int]) -> "StrokeFold":
        fold, by_pos = cls(conf), {}
        for *values, inside in merged:
            m = Merged.__new__(Merged)
            for f, v in zip(Merged.__slots__, values):
                setattr(m, f, v)
            by_pos[m.pos] = m
            if inside:
                fold.win.append(m)
        fold.ends = [(by_pos[a], by_pos[b], sure, used) for a, b, sure, used in ends]
        fold.free = [by_pos[p] for p in free]
        fold.count = fold.win[-1].pos + 1 if fold.win else 0
        return fold
