"""As-of joins and multi-pattern matching."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_last(left: DataFrame, right: DataFrame, on: str, value: str, width: int = 1024, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each left row the `value` of the last right row with right.on <= left.on.

    Rows meet in buckets of `width` positions; a bucket without an own right row takes the last one of the
    buckets before it from a table of one row per bucket.
    """
    b = F.floor(F.col(on) / width)
    l = left.withColumns({"_b": b, "_left": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    r = right.select(*keys, on, F.col(value).alias("_v")).withColumns({"_b": b, "_left": F.lit(0)})
    both = l.unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_b").orderBy(on, "_left").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_left") == 0, F.col(on))).alias("_t"))
    carry = tops.select(*keys, "_b", F.last("_t", True).over(before).alias("_c"))
    return (
        both.withColumn("_i", F.last("_v", True).over(inside))
        .filter("_left = 1")
        .join(carry, [*keys, "_b"])
        .withColumn(value, F.coalesce("_i", "_c"))
        .drop("_b", "_left", "_v", "_i", "_c")
    )


# ---- containment ------------------------------------------------------------------------------------------------

SLICE = 100_000  # patterns a task holds
SHARD = 16_000_000  # characters of text a task holds


class Matcher:
    """Counts patterns in texts through the words of the texts.

    A pattern without blanks inside lies in a single word, so a word's patterns are those among its stretches, worked out once
    per distinct word. A longer pattern is looked for where its longest piece was found.
    """

    def __init__(self, patterns: list[str]):
        self.alone: dict[str, int] = {}
        self.anchored: dict[str, list[int]] = {}
        self.blank: list[int] = []
        self.patterns = patterns
        for n, p in enumerate(patterns):
            pieces = p.split()
            if not pieces:
                self.blank.append(n)
            elif pieces[0] == p:
                self.alone[p] = n
            else:
                self.anchored.setdefault(max(pieces, key=len), []).append(n)
        self.sizes = sorted({len(p) for p in (*self.alone, *self.anchored)})
        self.known: dict[str, tuple[list[tuple[int, int]], list[int]]] = {}

    def _word(self, word: str) -> tuple[list[tuple[int, int]], list[int]]:
        if len(self.known) > 200_000:
            self.known.clear()
        parts = {word[i : i + n] for n in self.sizes if n <= len(word) for i in range(len(word) - n + 1)}
        counts = [(self.alone[s], word.count(s)) for s in parts & self.alone.keys()]
        leads = [n for s in parts & self.anchored.keys() for n in self.anchored[s]]
        self.known[word] = counts, leads
        return counts, leads

    def count(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        leads: set[int] = set()
        words: dict[str, int] = {}
        for w in text.split():
            words[w] = words.get(w, 0) + 1
        for w, times in words.items():
            counts, more = self.known.get(w) or self._word(w)
            for n, c in counts:
                out[n] = out.get(n, 0) + c * times
            leads.update(more)
        for n in (*leads, *self.blank):
            c = text.count(self.patterns[n])
            if c:
                out[n] = c
        return out


def find_patterns(docs: DataFrame, patterns: DataFrame, key: str, text: str = "text", slice_: int = SLICE, shard: int = SHARD) -> DataFrame:
    """(key, pattern, n): which patterns occur in which text, and how often without overlap.

    Shards of texts meet slices of patterns, each bounded, so any number of both can be matched; usually there is one slice, and
    texts are read once. Patterns travel by the shuffle and are never collected. Empty patterns and null texts give nothing.
    """
    p = patterns.select(F.col(patterns.columns[0]).alias("pattern")).filter("pattern <> ''").distinct()
    slices = max(1, math.ceil(p.count() / slice_))
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / shard))
    # long texts are dealt out by their own hash, so that they spread however the keys do
    left = docs.filter(F.length(text) > 0).select(key, F.col(text).alias("_text"), F.pmod(F.xxhash64(text, key), F.lit(shards)).cast("int").alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    right = p.select("pattern", F.pmod(F.xxhash64("pattern"), F.lit(slices)).cast("int").alias("_slice"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"))
    kind = docs.schema[key].dataType

    def match(texts: pa.Table, found: pa.Table) -> pa.Table:
        matcher = Matcher(found["pattern"].to_pylist() if texts.num_rows else [])
        rows, which, ns = [], [], []
        for r, t in enumerate(texts["_text"].to_pylist() if found.num_rows else ()):
            for n, c in matcher.count(t).items():
                rows.append(r), which.append(n), ns.append(c)
        keys = texts[key].take(pa.array(rows, pa.int64()))
        return pa.table({key: keys, "pattern": pa.array(matcher.patterns, pa.string()).take(pa.array(which, pa.int64())), "n": pa.array(ns, pa.int32())})

    schema = f"{key} {kind.simpleString()}, pattern string, n int"
    return left.groupBy("_shard", "_slice").cogroup(right.groupBy("_shard", "_slice")).applyInArrow(match, schema)
