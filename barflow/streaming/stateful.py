"""Stateful operators with typed state: strokes, windows by count, and a ledger of late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barflow.operators.structure.config import StructureConfig
from barflow.operators.structure.kernel import Merged, StrokeFold

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_typed_state(spark: SparkSession) -> None:
    """Typed state needs this store; a session that names another one keeps it for its other streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


BAR = "idx int, open double, high double, low double, close double, volume double"
WINDOW = "symbol string, end int, n int, open double, high double, low double, close double, volume double"


class CountWindows(StatefulProcessor):
    """The last `size` bars of each series in a ring; a window leaves at bar `first` and at every `step`-th bar after it, and
    holds the bars before that bar. Bars of one arrival are taken in order; bars at or before the newest one are passed over."""

    def __init__(self, size: int, step: int, first: int):
        self.size, self.step, self.first = size, step, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = BAR.replace(",", "").split()[::2]
        # (idx, open, high, low, close, volume)
        held = [tuple(b) for b in self.ring.get()] if self.ring.exists() else []
        out = []
        for bar in pd.concat(list(rows))[names].sort_values("idx").itertuples(index=False):
            if held and bar.idx <= held[-1][0]:
                continue
            if held and bar.idx >= self.first and (bar.idx - self.first) % self.step == 0:
                out.append((key[0], int(bar.idx), len(held), held[0][1], max(b[2] for b in held), min(b[3] for b in held), held[-1][4], sum(b[5] for b in held)))
            held.append((int(bar.idx), *map(float, bar[1:])))
            del held[: -self.size]
        self.ring.put(held)
        yield pd.DataFrame(out, columns=WINDOW.replace(",", "").split()[::2])

    def close(self) -> None:
        pass


def count_windows(bars: DataFrame, size: int = 300, step: int = 5, first: int = 200) -> DataFrame:
    """Overlapping windows of a bar stream (symbol, idx, open, high, low, close, volume) by count: `end`, the bars held, their
    first open, highest high, lowest low, last close and total volume."""
    use_typed_state(bars.sparkSession)
    return bars.groupBy("symbol").transformWithStateInPandas(CountWindows(size, step, first), WINDOW, "append", "none")


LEDGER = "symbol string, ts timestamp, seq long, price double, volume double, kind string, lateness double"


class LateLedger(StatefulProcessor):
    """Each series has its own frontier, the newest time seen. A row that lies more than `allowed` seconds behind it leaves as
    'late' with how far behind it was, every other one as 'kept'; counts of both are part of the state."""

    def __init__(self, allowed: float):
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("frontier", "newest timestamp, kept long, late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, kept, late = self.state.get() if self.state.exists() else (None, 0, 0)
        top = frontier = None if newest is None else pd.Timestamp(newest)
        for pdf in rows:
            # all rows of one arrival are held against the frontier before it, so their order does not matter
            behind = (frontier - pdf["ts"]).dt.total_seconds() if frontier is not None else pd.Series(0.0, index=pdf.index)
            is_late = behind > self.allowed
            top = pdf["ts"].max() if top is None else max(top, pdf["ts"].max())
            kept, late = kept + int((~is_late).sum()), late + int(is_late.sum())
            yield pdf.assign(symbol=key[0], kind=is_late.map({True: "late", False: "kept"}), lateness=behind.where(is_late, 0.0))[LEDGER.replace(",", "").split()[::2]]
        self.state.update((top.to_pydatetime(), kept, late))

    def close(self) -> None:
        pass


def ledger(ticks: DataFrame, allowed: str) -> DataFrame:
    """Ticks (symbol, ts, seq, price, volume) marked 'kept' or 'late', none dropped. `allowed` is an interval like '2 days'."""
    spark = ticks.sparkSession
    use_typed_state(spark)
    seconds = spark.range(1).select(F.expr(f"unix_seconds(timestamp'1970-01-01 00:00:00' + INTERVAL {allowed}) - unix_seconds(timestamp'1970-01-01 00:00:00')")).first()[0]
    # without a time zone in the session's way: the frontier compares times of one column only
    return ticks.groupBy("symbol").transformWithStateInPandas(LateLedger(float(seconds)), LEDGER, "append", "none")


def split_ledger(marked: DataFrame, path: str) -> None:
    """Run an available-now stream of marked rows into two folders, kept and late; a repeated batch overwrites itself."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for kind in ("kept", "late"):
            batch.filter(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{path}/{kind}/epoch={epoch}")
        batch.unpersist()

    q = marked.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, kept, late) over all epochs of `split_ledger`."""
    parts = [spark.read.parquet(f"{path}/{kind}").select("symbol", F.lit(kind).alias("kind")) for kind in ("kept", "late")]
    return parts[0].unionByName(parts[1]).groupBy("symbol").agg(F.count_if(F.col("kind") == "kept").alias("kept"), F.count_if(F.col("kind") == "late").alias("late"))


STROKES = "symbol string, kind string, idx int, dir int, is_sure boolean, begin_mb int, end_mb int, begin_bar int, end_bar int, begin_val double, end_val double"
_WHOLE = {"pos", "first", "last", "dir", "fx", "hi_bar", "lo_bar", "n"}
MERGED = ", ".join(f"{f} {'int' if f in _WHOLE else 'double'}" for f in Merged.__slots__) + ", inside boolean"


class Strokes(StatefulProcessor):
    """Bars in, strokes out. The state is typed: the merged bars since the last stroke end, the strokes that can still change, and
    the number of those that no longer can; it does not grow with the series. An arrival emits the strokes that it settled
    ('settled', once each), those that are open ('open'), and how many of its bars came late or twice ('late')."""

    def __init__(self, conf: StructureConfig):
        self.conf = conf

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "strokes int, newest timestamp, late long")
        self.merged = handle.getListState("merged", MERGED)
        self.ends = handle.getListState("ends", "a int, b int, sure boolean, used boolean")
        self.free = handle.getListState("free", "pos int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base, newest, before = self.done.get() if self.done.exists() else (0, None, 0)
        held = [[tuple(x) for x in s.get()] if s.exists() else [] for s in (self.merged, self.ends, self.free)]
        fold = StrokeFold.load(self.conf, held[0], held[1], [p for (p,) in held[2]])
        newest, late = None if newest is None else pd.Timestamp(newest), 0
        for bar in pd.concat(list(rows)).sort_values("ts").itertuples():
            if newest is not None and bar.ts <= newest:
                late += 1
                continue
            newest = bar.ts
            fold.push(int(bar.idx), float(bar.high), float(bar.low))
        strokes = fold.strokes()
        settled = fold.settle()
        out = [(key[0], "settled" if x.pos < settled else "open", base + x.pos, 1 if x.up else -1, x.sure, x.ref_a, x.ref_b, x.a_bar, x.b_bar, x.begin, x.end) for x in strokes]
        if late:
            out.append((key[0], "late", late, *[None] * 8))
        merged, ends, free = fold.dump()
        for state, values in ((self.merged, merged), (self.ends, ends), (self.free, [(p,) for p in free])):
            state.put(values) if values else state.clear()
        self.done.update((base + settled, newest.to_pydatetime(), before + late))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STROKES.split(", ")])

    def close(self) -> None:
        pass


def strokes(bars: DataFrame, conf: StructureConfig | None = None) -> DataFrame:
    """Strokes of a bar stream (symbol, idx, ts, high, low)."""
    use_typed_state(bars.sparkSession)
    x = bars.select("symbol", "idx", "ts", "high", "low")
    return x.groupBy("symbol").transformWithStateInPandas(Strokes(conf or StructureConfig()), STROKES, "append", "none")


def upsert_strokes(stream: DataFrame, path: str) -> None:
    """Run an available-now stream of strokes into versioned folders: settled strokes are only ever added, and each epoch writes the
    whole short table of open ones anew: its own series' and, of the others, what the epoch before had. A repeated epoch overwrites itself."""
    spark = stream.sparkSession

    def save(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for kind in ("settled", "late"):
            batch.filter(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{path}/{kind}/epoch={epoch}")
        fresh = batch.filter("kind = 'open'").drop("kind")
        if epoch:
            old = spark.read.schema(fresh.schema).parquet(f"{path}/open-{epoch - 1}")
            fresh = old.join(batch.select("symbol").distinct(), "symbol", "left_anti").unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{path}/open-{epoch}")
        spark.createDataFrame([(epoch,)], "epoch long").coalesce(1).write.mode("overwrite").json(f"{path}/newest")
        batch.unpersist()

    q = stream.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def current_strokes(spark: SparkSession, path: str) -> DataFrame:
    """All strokes as of the newest epoch: the settled ones and the short table of open ones."""
    epoch = spark.read.schema("epoch long").json(f"{path}/newest").first()[0]
    return spark.read.parquet(f"{path}/settled").drop("epoch").unionByName(spark.read.parquet(f"{path}/open-{epoch}"))
