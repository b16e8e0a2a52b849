"""Exact top-k by inner product with a table of distances to pivots.

1. Equal vectors become one entity with its smallest ids. An extra coordinate sqrt(M^2 - |x|^2), 0 for queries, turns inner
   products into distances: |q - x|^2 = |q|^2 + M^2 - 2 q.x, with M the largest norm.
2. Pivots are picked farthest-first from a bounded sample. Every entity's distances to all pivots are computed once and
   written; its nearest pivot names its cell, and cells are merged or dealt out into shards of bounded size.
3. |d(q, p) - d(x, p)| is a lower bound on |q - x| for every pivot p. A query first searches the shard it lies in; the
   k-th score found there lets the bounds of whole shards eliminate shards before any of their rows move.
4. In a shard the maximum bound over the pivots orders the candidates; they are evaluated in that order, in growing chunks,
   until no remaining bound reaches the k-th score. Bounds carry a margin for rounding, scores are exact.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.vectors import exact, finite, integers, matrix, padded, smallest_ids, stored


@dataclasses.dataclass(frozen=True)
class Settings:
    pivots: int = 32
    #: entities that pivots are picked from
    sample: int = 4096
    #: candidates and queries of a shard
    shard: int = 2048
    queries: int = 1024
    #: candidates evaluated before the stopping test runs first
    chunk: int = 64
    #: parts that queries of one vector are dealt over when results are joined to them
    salts: int = 16


FOUND = "entity long, score long, ids array<long>"


def pick_pivots(x: np.ndarray, height: np.ndarray, most: int) -> np.ndarray:
    """Places of at most `most` pivots: the longest vector, then always the one farthest from all picked ones."""
    y = np.concatenate([x, height[:, None]], axis=1).astype(np.float64)
    picked = [int((x.astype(np.float64) ** 2).sum(1).argmax())]
    far = np.full(len(y), np.inf)
    while len(picked) < most:
        far = np.minimum(far, ((y - y[picked[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        picked.append(int(far.argmax()))
    return np.array(picked)


def distances(x: np.ndarray, height: np.ndarray, p: np.ndarray, p_height: np.ndarray) -> np.ndarray:
    """(rows, pivots) in the space with the extra coordinate."""
    x, p = x.astype(np.float64), p.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T) + (height[:, None] - p_height) ** 2
    return np.sqrt(np.maximum(square, 0))


def heights(x: np.ndarray, longest: float) -> np.ndarray:
    return np.sqrt(np.maximum(longest - (x.astype(np.float64) ** 2).sum(1), 0))


def best(q: np.ndarray, q_dist: np.ndarray, least: np.ndarray, x: np.ndarray, dist: np.ndarray, first: np.ndarray, longest: float, k: int, s: Settings):
    """For every query the places and scores of the k best rows of x that reach `least`, ties to the smaller `first` id."""
    x, q = exact(x, q)
    square = (q.astype(np.float64) ** 2).sum(1)
    for i in range(len(q)):
        bound = np.abs(dist - q_dist[i]).max(1)
        # the margin covers the rounding of distances
        top = (square[i] + longest - bound * bound) / 2 + 1e-9 * (square[i] + longest) + 1e-3
        open_ = np.flatnonzero(top >= least[i])
        open_ = open_[np.argsort(-top[open_], kind="stable")]
        scores = np.zeros(0, x.dtype)
        kth, step = -np.inf, s.chunk
        while len(scores) < len(open_) and top[open_[len(scores)]] >= kth:
            scores = np.concatenate([scores, x[open_[len(scores) : len(scores) + step]] @ q[i]])
            step *= 2
            if len(scores) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        seen = open_[: len(scores)]
        keep = np.lexsort((first[seen], -scores))[:k]
        yield i, seen[keep], scores[keep].astype(np.int64)


def _shards(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """cell -> (first shard, shards): large cells are dealt over several shards, small neighbours share one."""
    out, at, room = {}, -1, 0
    for cell in sorted(counts):
        n = counts[cell]
        if n > size:
            parts = -(-n // size)
            at += 1
            out[cell] = (at, parts)
            at, room = at + parts - 1, 0
        else:
            if n > room:
                at, room = at + 1, size
            out[cell], room = (at, 1), room - n
    return out


def _placed(df: DataFrame, where: dict[int, tuple[int, int]], name: str) -> DataFrame:
    """`name`: the shard of every row by its cell."""
    if not where:
        return df.withColumn(name, F.lit(0))
    firsts = F.create_map(*[F.lit(v) for c, (f, _) in where.items() for v in (c, f)])
    parts = F.create_map(*[F.lit(v) for c, (_, n) in where.items() for v in (c, n)])
    return df.withColumn(name, (firsts[F.col("cell")] + F.pmod(F.xxhash64("entity"), parts[F.col("cell")])).cast("int"))


def _table(rows: DataFrame, k: int, s: Settings) -> tuple[DataFrame, float] | None:
    """The pivot table: entity, ids, v, asks, dist, q_dist and cell, and the largest squared norm; None without rows."""
    entities = smallest_ids(rows, ["v"], k + 1).withColumn("entity", F.monotonically_increasing_id())
    asked = rows.filter("asks").select("v").distinct().withColumn("asks", F.lit(True))
    entities = stored(entities.join(asked, "v", "left").select("entity", "ids", "v", F.coalesce("asks", F.lit(False)).alias("asks")))
    square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b.cast("double") * b)
    longest = entities.agg(F.max(square)).first()[0]
    if longest is None:
        return None
    sample = matrix(entities.select("v", F.xxhash64("v").alias("h"), "entity").orderBy("h", "entity").limit(s.sample).toPandas()["v"])  # `sample` rows
    high = heights(sample, longest)
    picked = pick_pivots(sample, high, s.pivots)
    p, p_high = sample[picked], high[picked]

    def measure(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = matrix(pdf["v"])
            dist = distances(x, heights(x, longest), p, p_high)
            q_dist = distances(x, np.zeros(len(x)), p, p_high)
            asks = pdf["asks"].to_numpy(bool)
            yield pdf.assign(dist=list(dist), q_dist=[d if a else None for d, a in zip(q_dist, asks)], cell=dist.argmin(1))

    schema = "entity long, ids array<long>, v array<int>, asks boolean, dist array<double>, q_dist array<double>, cell int"
    return stored(entities.mapInPandas(measure, schema)), longest


def _spans(df: DataFrame, key: str, column: str, n: int, prefix: str) -> DataFrame:
    """The least and largest distance to every pivot, by shard."""
    cells = [F.element_at(column, i + 1) for i in range(n)]
    return df.groupBy(key).agg(F.array(*map(F.min, cells)).alias(f"{prefix}_low"), F.array(*map(F.max, cells)).alias(f"{prefix}_high"))


def entity_results(rows: DataFrame, k: int, s: Settings) -> tuple[DataFrame, DataFrame] | None:
    """(results, table): for every asked entity the k + 1 best rows as `found`, an array of (minus score, vec_id)."""
    made = _table(rows, k, s)
    if made is None:
        return None
    table, longest = made
    cells = table.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()  # a row per pivot
    table = _placed(table, _shards({c["cell"]: c["n"] for c in cells}, s.shard), "shard")
    asks = _placed(table.filter("asks").select("entity", "v", "q_dist", "cell", "shard"), _shards({c["cell"]: c["q"] for c in cells if c["q"]}, s.queries), "part")
    n_pivots = table.select(F.size("dist")).first()[0]

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ask = matrix(pdf["v"]), np.flatnonzero(pdf["asks"].to_numpy(bool))
        if not len(ask):
            return _frame([], np.zeros(0), pd.Series(dtype=object))
        first = pdf["ids"].map(lambda i: i[0]).to_numpy()
        q_dist = np.stack(pdf["q_dist"].iloc[ask].to_list())
        return _frame(best(x[ask], q_dist, np.full(len(ask), -np.inf), x, np.stack(pdf["dist"].to_list()), first, longest, k + 1, s), pdf["entity"].to_numpy()[ask], pdf["ids"])

    near = stored(table.select("shard", "entity", "ids", "v", "asks", "dist", "q_dist").groupBy("shard").applyInPandas(home, FOUND))
    rows_near = near.groupBy("entity").agg(F.sum(F.size("ids")).alias("_n"), F.min("score").alias("_low"))
    # the k+1-th score at home; fewer rows set no bound
    asks = asks.join(rows_near, "entity", "left").withColumn("least", F.when(F.col("_n") > k, F.col("_low")))
    square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b.cast("double") * b)
    reach = F.when(F.col("least").isNull(), F.lit(float("inf"))).otherwise(square + F.lit(longest) - 2.0 * F.col("least"))
    asks = stored(asks.withColumn("reach", reach).select("entity", "v", "q_dist", "shard", "part", "least", "reach"))

    # shards against shards: rows of bounds only
    by_query = _spans(asks, "part", "q_dist", n_pivots, "q").join(asks.groupBy("part").agg(F.max("reach").alias("reach")), "part")
    by_row = _spans(table, "shard", "dist", n_pivots, "c")
    gap = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    bound = F.greatest(F.array_max(gap("c_low", "q_high")), F.array_max(gap("q_low", "c_high")), F.lit(0.0))
    pairs = by_query.crossJoin(by_row).filter(bound * bound <= F.col("reach") * (1 + 1e-9) + F.lit(1e-9 * longest + 1e-3)).select("part", "shard")
    pairs = stored(pairs.distinct())

    def search(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q = q[q["shard"] != key[1]]
        if not len(q) or not len(c):
            return _frame([], np.zeros(0), pd.Series(dtype=object))
        least = q["least"].astype("float64").fillna(-np.inf).to_numpy()
        first = c["ids"].map(lambda i: i[0]).to_numpy()
        found = best(matrix(q["v"]), np.stack(q["q_dist"].to_list()), least, matrix(c["v"]), np.stack(c["dist"].to_list()), first, longest, k + 1, s)
        return _frame(found, q["entity"].to_numpy(), c["ids"])

    left = asks.select("entity", "v", "q_dist", "shard", "least", "part").join(pairs.select("part", F.col("shard").alias("to")), "part")
    right = table.select("shard", "ids", "v", "dist").join(pairs.select(F.col("part").alias("for"), "shard"), "shard")
    far = left.groupBy("part", "to").cogroup(right.groupBy("for", "shard")).applyInPandas(search, FOUND)
    each = near.unionByName(far).select("entity", "score", F.explode("ids").alias("vec_id"))
    return _top(each, k), table


def _frame(found, entity: np.ndarray, ids: pd.Series) -> pd.DataFrame:
    who, scores, lists = [], [], []
    for i, places, score in found:
        who += [entity[i]] * len(places)
        scores += score.tolist()
        lists += ids.iloc[places].to_list()
    return pd.DataFrame({"entity": np.array(who, np.int64), "score": np.array(scores, np.int64), "ids": pd.Series(lists, dtype=object)})


def _top(each: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "vec_id"))
    few = each.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1)
    return few.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score: for every row with `is_query` the k other rows of highest integer inner product.

    Components are floor(scale * x). Ties go to the smaller vec_id. Rows that repeat, under one vec_id or several, are rows of
    their own: only the query's own row is left out, and each repeated query is answered. Rows whose vec_id or vector is null
    or whose vector holds null or non-finite components take no part; shorter vectors are filled up with zeros; scaled
    components beyond 2^26 count as 2^26. Empty tables and tables without queries give no rows; other columns are left out.
    """
    columns = (F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stored(vectors.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(*columns))
    rows = padded(rows)
    made = entity_results(rows, k, s)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    results, table = made
    answers = results.join(table.select("entity", "v"), "entity").select("v", "found", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("_salt"))
    asked = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(s.salts)).cast("int").alias("_salt"))
    own = F.struct((-F.aggregate("v", F.lit(0).cast("long"), lambda a, b: a + b.cast("long") * b)).alias("minus"), F.col("query_id").alias("vec_id"))
    at = F.array_position("found", own).cast("int")
    rest = F.when(at == 0, F.col("found")).otherwise(F.concat(F.slice("found", F.lit(1), at - 1), F.slice("found", at + 1, F.size("found"))))
    out = asked.join(answers, ["v", "_salt"]).select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
