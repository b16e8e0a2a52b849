"""Hard negatives of anchors by branch and bound over vertical fragments.

1. Rows of one label and vector become one entity with its smallest ids. Entities are dealt into shards of bounded size, and a
   shard is stored by dimension: a column of values with its least and largest one.
2. An anchor reads a shard's columns in the order of its own components' magnitudes. After each step the partial sums and the
   least and largest contributions that the unread dimensions can still make bound every score from both sides.
3. Positives: candidates whose upper bound is below the k-th lower bound leave the bitmap. Negatives: a candidate stays while
   some window of the anchor can still hold it among its best; a window's k-th certain member raises its lower end.
4. What is left after the last column has its exact score. Shards' best rows are merged by a rank over (anchor, window).
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.vectors import finite, integers, matrix, padded, smallest_ids, stored


@dataclasses.dataclass(frozen=True)
class Settings:
    #: entities of a shard, anchors of a block
    shard: int = 8192
    block: int = 1024
    #: dimensions read between two looks at the bounds
    step: int = 8
    #: parts that anchors of one vector are dealt over when results are joined to them
    salts: int = 16


def _bounds(columns: list[np.ndarray], low: np.ndarray, high: np.ndarray, q: np.ndarray, alive: np.ndarray, step: int):
    """Yields (alive places, lower bounds, upper bounds) after every `step` columns, the last time exact; takes back, by send,
    the mask of those to go on with."""
    order = np.argsort(-np.abs(q), kind="stable")
    ends = np.stack([q[order] * low[order], q[order] * high[order]])
    least = np.append(np.cumsum(ends.min(0)[::-1])[::-1], 0)
    most = np.append(np.cumsum(ends.max(0)[::-1])[::-1], 0)
    part = np.zeros(len(alive), np.int64)
    for at in range(0, max(len(order), 1), step):
        for d in order[at : at + step]:
            if q[d]:
                part += columns[d][alive] * q[d]
        read = min(at + step, len(order))
        keep = yield alive, part + least[read], part + most[read]
        if keep is not None and not keep.all():
            alive, part = alive[keep], part[keep]


def highest(bounds, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of all that reach the k-th highest score."""
    places = scores = np.zeros(0, np.int64)
    keep = None
    while True:
        try:
            places, low, up = bounds.send(keep)
        except StopIteration:
            return places[keep], scores[keep]
        scores = up
        kth = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.iinfo(np.int64).min
        keep = up >= kth


def windows(bounds, low_end: np.ndarray, high_end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of all that are among the k highest, ties included, of some window [low_end, high_end]."""
    places = scores = np.zeros(0, np.int64)
    keep = None
    while True:
        try:
            places, low, up = bounds.send(keep)
        except StopIteration:
            return places[keep], scores[keep]
        scores = up
        keep = np.zeros(len(places), bool)
        for a, b in zip(low_end, high_end):
            sure = low[(low >= a) & (up <= b)]
            floor = max(a, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else a
            keep |= (up >= floor) & (low <= b)


LABEL, COUNT, IDS = -1, -2, -3


def fragments(entities: DataFrame, shards: int) -> DataFrame:
    """shard, dim, column (binary of little-endian long), low, high.

    Below dimension 0 stand the labels' codes, the number of ids, and one column for each of an entity's smallest ids.
    """

    def turn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", kind="stable")
        x, lists = matrix(pdf["v"]), pdf["ids"].to_list()
        n_ids = np.array(list(map(len, lists)))
        ids = np.zeros((len(lists), n_ids.max()), np.int64)
        ids[np.arange(ids.shape[1]) < n_ids[:, None]] = np.concatenate(lists)
        columns = {IDS - j: c for j, c in enumerate(ids.T)} | {COUNT: n_ids, LABEL: pdf["code"].to_numpy()} | dict(enumerate(x.T))
        columns = {d: np.ascontiguousarray(c, np.int64) for d, c in columns.items()}
        return pd.DataFrame({"shard": key[0], "dim": columns.keys(), "column": [c.tobytes() for c in columns.values()], "low": [c.min() for c in columns.values()], "high": [c.max() for c in columns.values()]})

    dealt = entities.withColumn("shard", F.pmod(F.xxhash64("entity"), F.lit(shards)).cast("int")).withColumn("first", F.element_at("ids", 1))
    return dealt.select("shard", "first", "ids", "code", "v").groupBy("shard").applyInPandas(turn, "shard int, dim int, column binary, low long, high long")


class Shard:
    """A shard's columns by dimension; rows stand by their smallest id."""

    def __init__(self, pieces: pd.DataFrame):
        column = {d: np.frombuffer(b, np.int64) for d, b in zip(pieces["dim"], pieces["column"])}
        ends = pieces[pieces["dim"] >= 0].sort_values("dim")
        self.low, self.high = ends["low"].to_numpy(np.int64), ends["high"].to_numpy(np.int64)
        self.columns = [column[d] for d in range(len(ends))]
        self.label, self.count = column[LABEL], column[COUNT]
        self.ids = [column[IDS - j] for j in range(self.count.max())]

    def bounds(self, q: np.ndarray, among: np.ndarray, step: int):
        return _bounds(self.columns, self.low, self.high, q, np.flatnonzero(among), step)

    def ids_of(self, places: np.ndarray) -> list[list[int]]:
        return [[int(self.ids[j][p]) for j in range(self.count[p])] for p in places]


def _against(anchors: DataFrame, pieces: DataFrame, shards: int, fn, schema: str) -> DataFrame:
    """fn(anchor block, shard's fragments) for every block and shard; a task holds one of each."""
    left = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    blocks = anchors.select(F.col("block").alias("to")).distinct()  # a row per 1024 anchors
    right = pieces.crossJoin(blocks)
    return left.groupBy("block", "shard").cogroup(right.groupBy("to", "shard")).applyInPandas(fn, schema)


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """`hits`: for every `keys` the k best rows (minus score, vec_id) of what the shards found."""
    each = found.select(*keys, "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    few = each.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("hits"))


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, scale: int = 256, percent: tuple[int, int] = (50, 95), s: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the `positives` other rows of its label with the highest integer inner product; for each the
    `negatives` best rows of other labels are returned whose score lies between the two percentages of the positive's. Ties go
    to the smaller vec_id. Components are floor(scale * x). Rows that repeat, under one vec_id or several, are rows of their
    own: only the anchor's own row is no positive, and each repeated anchor is answered. Rows whose label, vec_id or vector is
    null or whose vector holds null or non-finite components take no part; shorter vectors are filled up with zeros; scaled
    components beyond 2^26 count as 2^26. Anchors without positives, positives with an empty window and empty tables give no
    rows; other columns are left out.
    """
    k = positives + 1
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    kept = kept.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    rows = stored(kept.select("vec_id", F.xxhash64("label").alias("code"), integers(F.col("embedding"), scale).alias("v"), "asks"))
    rows = padded(rows)
    entities = stored(smallest_ids(rows, ["code", "v"], max(k, negatives)).withColumn("entity", F.monotonically_increasing_id()))
    asked = rows.filter("asks").select("code", "v").distinct()
    anchors = stored(entities.select("entity", "code", "v").join(asked, ["code", "v"]))
    n, m = entities.count(), anchors.count()
    shards = max(1, -(-n // s.shard))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(max(1, -(-m // s.block)))).cast("int"))
    pieces = stored(fragments(entities, shards))

    def alike(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            shard = Shard(c)
            for e, own, q in zip(a["entity"], a["code"], matrix(a["v"])):
                places, score = highest(shard.bounds(q, shard.label == own, s.step), k)
                best = np.lexsort((places, -score))[:k]
                out += zip([e] * len(best), score[best].tolist(), shard.ids_of(places[best]))
        return pd.DataFrame(out, columns=["anchor", "score", "ids"])

    near = stored(_merged(_against(anchors, pieces, shards, alike, "anchor long, score long, ids array<long>"), ["anchor"], k))

    # the windows of an anchor's vector: one for each positive score that any of its rows can have
    scores = F.array_distinct(F.transform("hits", lambda h: -h["minus"]))
    asks = anchors.join(near.select(F.col("anchor").alias("entity"), scores.alias("scores")), "entity")
    low_percent, high_percent = percent

    def other(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            shard = Shard(c)
            for e, own, q, p in zip(a["entity"], a["code"], matrix(a["v"]), a["scores"]):
                p = np.asarray(p, np.int64)
                low_end, high_end = -(-(low_percent * p) // 100), (high_percent * p) // 100
                some = low_end <= high_end
                if not some.any():
                    continue
                places, score = windows(shard.bounds(q, shard.label != own, s.step), low_end[some], high_end[some], negatives)
                for x, a_end, b_end in zip(p[some].tolist(), low_end[some], high_end[some]):
                    inside = np.flatnonzero((score >= a_end) & (score <= b_end))
                    best = inside[np.lexsort((places[inside], -score[inside]))[:negatives]]
                    out += zip([e] * len(best), [x] * len(best), score[best].tolist(), shard.ids_of(places[best]))
        return pd.DataFrame(out, columns=["anchor", "positive_score", "score", "ids"])

    found = _against(asks, pieces, shards, other, "anchor long, positive_score long, score long, ids array<long>")
    hard = _merged(found, ["anchor", "positive_score"], negatives)
    by_anchor = hard.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("positive_score", "hits"))).alias("hard"))  # at most k windows
    answers = near.join(by_anchor, "anchor").join(anchors.select(F.col("entity").alias("anchor"), "code", "v"), "anchor")
    answers = answers.select("code", "v", "hits", "hard", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("_salt"))
    each = rows.filter("asks").select(F.col("vec_id").alias("anchor_id"), "code", "v", F.pmod(F.xxhash64("vec_id"), F.lit(s.salts)).cast("int").alias("_salt"))
    own = F.struct((-F.aggregate("v", F.lit(0).cast("long"), lambda a, b: a + b.cast("long") * b)).alias("minus"), F.col("anchor_id").alias("vec_id"))
    at = F.array_position("hits", own).cast("int")
    rest = F.when(at == 0, F.col("hits")).otherwise(F.concat(F.slice("hits", F.lit(1), at - 1), F.slice("hits", at + 1, F.size("hits"))))
    out = each.join(answers, ["code", "v", "_salt"]).select("anchor_id", "hard", F.explode(F.slice(rest, 1, positives)).alias("positive"))
    out = out.select("anchor_id", F.col("positive.vec_id").alias("positive_id"), (-F.col("positive.minus")).alias("positive_score"), "hard")
    out = out.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.element_at("hard", F.col("positive_score"))).alias("pos", "negative"))
    return out.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("negative.vec_id").alias("negative_id"), "positive_score", (-F.col("negative.minus")).alias("negative_score"))
