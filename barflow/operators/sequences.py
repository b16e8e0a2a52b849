"""Setup and countdown sequences. The setup count is a run length; the countdown is a fold over the sorted series."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "symbol string, idx int, kind string, dir int, count int"


@dataclass(frozen=True)
class SequenceRules:
    length: int = 9
    setup_back: int = 4
    countdown_back: int = 2
    countdown_length: int = 13
    gap_rule: bool = True
    setup_on_close: bool = True
    countdown_on_close: bool = True


@dataclass
class Run:
    """One setup, and the countdown it starts when it reaches full length."""

    dir: int
    born: int
    count: int = 0
    open: bool = True
    limit: float | None = None  # the peak that cancels the countdown; set when it starts
    down: int = 0
    over: bool = False


@dataclass
class SequenceFold:
    rules: SequenceRules
    bars: list[tuple[float, float, float]] = field(default_factory=list)  # close, high, low
    runs: list[Run] = field(default_factory=list)

    def _ref(self, i: int, direction: int, on_close: bool) -> float:
        close, high, low = self.bars[i]
        return close if on_close else high if direction > 0 else low

    def push(self, close: float, high: float, low: float) -> list[tuple[str, int, int]]:
        r = self.rules
        self.bars.append((close, high, low))
        n = len(self.bars) - 1
        if n < r.setup_back + 1:
            return []
        move = (close > self.bars[n - r.setup_back][0]) - (close < self.bars[n - r.setup_back][0])
        if move:
            if not any(x.dir == move and x.open for x in self.runs):
                self.runs.append(Run(move, n))
            for x in self.runs:
                if x.dir == -move and x.limit is None:
                    x.open = False
        self._drop()
        out, winner = [], None
        for x in self.runs:
            hits = self._step(x, n)
            out += [(x, *h) for h in hits]
            if ("setup", x.dir, r.length) in hits:
                winner = x
        if winner is not None:
            self.runs = [winner]
            # the other runs end here, but what they counted on this bar was already reported only for the winner
            out = [h for h in out if h[0] is winner]
        self._drop()
        return [h[1:] for h in out]

    def _step(self, x: Run, n: int) -> list[tuple[str, int, int]]:
        r, hits = self.rules, []
        close = self.bars[n][0]
        if x.open:
            ref = self._ref(n - r.setup_back, x.dir, r.setup_on_close)
            if close * x.dir > ref * x.dir:
                x.count += 1
                hits.append(("setup", x.dir, x.count))
            else:
                x.open = False
        if x.count == r.length and x.open and x.limit is None:
            x.limit = self._peak(x)
        if x.limit is not None and not x.over:
            if x.down == r.countdown_length or (self.bars[n][1] > x.limit if x.dir < 0 else self.bars[n][2] < x.limit):
                x.over = True
            elif close * x.dir > self._ref(n - r.countdown_back, x.dir, r.countdown_on_close) * x.dir:
                x.down += 1
                hits.append(("countdown", x.dir, x.down))
        return hits

    def _peak(self, x: Run) -> float:
        """Extreme of the setup bars; a gap at its start brings in the close before."""
        bars = self.bars[x.born : x.born + self.rules.length]
        before = self.bars[x.born - self.rules.setup_back - 1][0]
        if x.dir < 0:
            peak = max(b[1] for b in bars)
            return max(peak, before) if self.rules.gap_rule and bars[0][1] < before else peak
        peak = min(b[2] for b in bars)
        return min(peak, before) if self.rules.gap_rule and bars[0][2] > before else peak

    def _drop(self) -> None:
        self.runs = [x for x in self.runs if (x.open or x.limit is not None) and not x.over]


def setups(bars: DataFrame, rules: SequenceRules | None = None) -> DataFrame:
    """(symbol, idx, kind, dir, count) for every bar that extends a setup or a countdown."""
    rules = rules or SequenceRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, fold = None, None
        for b in batches:
            rows = []
            for sym, idx, close, high, low in zip(*(b.column(c).to_pylist() for c in ("symbol", "idx", "close", "high", "low"))):
                if sym != symbol:
                    symbol, fold = sym, SequenceFold(rules)
                rows += [(sym, idx, *h) for h in fold.push(close, high, low)]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["symbol", "idx", "kind", "dir", "count"])

    n = 2 * bars.sparkSession.sparkContext.defaultParallelism
    return (
        bars.select("symbol", F.col("idx").cast("int").alias("idx"), "close", "high", "low")
        .repartition(n, "symbol").sortWithinPartitions("symbol", "idx").mapInArrow(run, SCHEMA)
    )
