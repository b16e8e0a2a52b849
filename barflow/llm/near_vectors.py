"""Near-duplicate vectors by range search in robust-pruned graphs.

1. Vectors that cannot link (null, zero, null or non-finite components, null label) are set aside; identical vectors of a
   label become one entity with a weight.
2. A label's entities are split into regions: centroids come from a bounded sample (`Settings.sample`), and every entity goes
   to its nearest centroid and to all within a margin that provably brings the two ends of any link together (`assign`).
3. In a region, overlapping cluster shards each get a graph by robust pruning, and the adjacency lists are united. Every
   entity searches greedily from the shards' medoids, and then expands over all neighbours in range until none is new.
4. An audit holds some of the region's queries against brute force; if links are missing, the search is widened until the
   audit passes. Every reported link is verified by its cosine in double precision.
5. At the end a fixed set of queries is held against all entities of their labels; that is the recall reported.

A region that splitting would not make cheaper, such as a third of all rows around one point, is compared whole, in pairs of blocks. A link
found in several regions counts in the smallest they share, so counts and spanning edges leave a task, never its pairs.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import cut
from barflow.llm.components import components


@dataclasses.dataclass(frozen=True)
class Settings:
    radius: float = 0.98
    #: entities of a region, and of a shard inside it
    region: int = 3000
    shard: int = 300
    #: rows of a group that centroids are fitted on
    sample: int = 20_000
    levels: int = 3
    degree: int = 20
    alpha: float = 1.2
    beam: int = 24
    #: neighbours this much below the radius are expanded too
    slack: float = 0.04
    audit: int = 48
    needed_recall: float = 0.995
    #: queries of the whole table held against all entities of their label
    audited: int = 200


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means; empty clusters keep their old centre."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def reach(radius: float) -> float:
    """The largest distance of two unit vectors with this cosine."""
    return (2 - 2 * radius) ** 0.5


def apart(c: np.ndarray, least: float) -> np.ndarray:
    """Centroids without those nearer than `least` to one kept before: between such, nearly all vectors would go to both."""
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or ((c[kept] - c[i]) ** 2).sum(1).min() > least * least:
            kept.append(i)
    return c[kept]


def assign(x: np.ndarray, c: np.ndarray, radius: float) -> np.ndarray:
    """(vectors, centroids): whether the centroid gets the vector.

    Let x be nearest to c and y to d, with |x - y| <= r. Then (x.c - x.d) + (y.d - y.c) = (x - y).(c - d) <= r |c - d|, and
    both terms are at least 0, so one is at most r |c - d| / 2. Whoever has that one goes to the other's centroid as well,
    so every link has a region with both ends.
    """
    s = x @ c.T
    near = s.argmax(1)
    width = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    return s.max(1, keepdims=True) - s <= reach(radius) / 2 * width[near] + 1e-4  # single precision


def robust_prune(x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(n, degree) neighbours of every vector among all others, -1 where pruned away.

    The nearest remaining candidate is kept, and those it covers, at alpha times their distance to it, are dropped.
    """
    n = len(x)
    d = np.maximum(2 - 2 * (x @ x.T), 0)
    left = ~np.eye(n, dtype=bool)
    out = np.full((n, min(degree, max(n - 1, 1))), -1)
    for r in range(out.shape[1]):
        masked = np.where(left, d, np.inf)
        pick = masked.argmin(1)
        rows = np.flatnonzero(left[np.arange(n), pick])
        if not len(rows):
            break
        out[rows, r] = pick[rows]
        left[rows] &= alpha * alpha * d[pick[rows]] > d[rows]
        left[rows, pick[rows]] = False
    return out


def build(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency, entry points): graphs of overlapping shards united; the entries are the shards' medoids."""
    n = len(x)
    k = max(1, -(-n // s.shard))
    c = centroids(x, k)
    near = np.argsort(-(x @ c.T), axis=1)[:, : min(2, len(c))]
    src, dst, entries = [], [], []
    for j in range(len(c)):
        rows = np.flatnonzero((near == j).any(1))
        if not len(rows):
            continue
        entries.append(rows[(x[rows] @ c[j]).argmax()])
        # a shard that came out much too large is dealt over several; the union joins them through their second shards
        for part in np.array_split(rows, max(1, len(rows) // (4 * s.shard))):
            adj = robust_prune(x[part], s.degree, s.alpha)
            a, b = np.nonzero(adj >= 0)
            # edges run both ways
            src += [part[a], part[adj[a, b]]]
            dst += [part[adj[a, b]], part[a]]
            entries.append(part[0])
    pairs = np.unique(np.concatenate(src) * n + np.concatenate(dst)) if src else np.zeros(0, np.int64)
    a, b = pairs // n, pairs % n
    first = np.searchsorted(a, np.arange(n + 1))
    width = int(np.diff(first).max()) if len(pairs) else 1
    adjacency = np.full((n, max(width, 1)), -1)
    adjacency[a, np.arange(len(a)) - first[a]] = b
    return adjacency, np.unique(entries)


def range_search(q: np.ndarray, x: np.ndarray, adjacency: np.ndarray, entries: np.ndarray, s: Settings, beam: int) -> np.ndarray:
    """(queries, vectors) similarities of all pairs that the search looked at, -2 elsewhere."""
    m, n = len(q), len(x)
    sims = np.full((m, n), -2, np.float32)
    sims[:, entries] = q @ x[entries].T
    done = np.zeros((m, n), bool)

    def look(rows: np.ndarray, nodes: np.ndarray) -> None:
        nb = adjacency[nodes]
        r = np.repeat(rows, nb.shape[1])
        nb = nb.ravel()
        new = nb >= 0
        r, nb = r[new], nb[new]
        new = sims[r, nb] < -1.5
        r, nb = r[new], nb[new]
        for at in range(0, len(r), 100_000):
            i, j = r[at : at + 100_000], nb[at : at + 100_000]
            sims[i, j] = np.einsum("ij,ij->i", q[i], x[j])

    active, beam = np.arange(m), min(beam, n)
    while len(active):
        top = np.argpartition(-sims[active], beam - 1, axis=1)[:, :beam]
        value = sims[active[:, None], top]
        value = np.where((value > -1.5) & ~done[active[:, None], top], value, -3)
        pick = value.argmax(1)
        go = value[np.arange(len(active)), pick] > -2.5
        active, node = active[go], top[np.arange(len(top)), pick][go]
        done[active, node] = True
        look(active, node)
    while True:
        r, node = np.nonzero((sims >= s.radius - s.slack) & ~done)
        if not len(r):
            return sims
        done[r, node] = True
        for at in range(0, len(r), 50_000):
            look(r[at : at + 50_000], node[at : at + 50_000])


def links_of(q: np.ndarray, x: np.ndarray, s: Settings, own: np.ndarray, graph: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of all verified pairs with cosine of at least the radius; `own` is the query's own place in x, or -1.

    Without a graph, or where the audit still misses links at eight times the beam, every pair is compared."""
    qf, xf = q.astype(np.float32), x.astype(np.float32)
    search = _widened(q, x, qf, xf, s, own) if graph else None
    rows, cols = [], []
    for at in range(0, len(q), 500):
        part = np.arange(at, min(at + 500, len(q)))
        sims = range_search(qf[part], xf, *search) if search else qf[part] @ xf.T
        i, j = np.nonzero(sims > s.radius - 1e-3)
        for k in range(0, len(i), 200_000):
            a, b = part[i[k : k + 200_000]], j[k : k + 200_000]
            true = np.einsum("ij,ij->i", q[a], x[b]) >= s.radius
            rows.append(a[true])
            cols.append(b[true])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *cols])


def _widened(q: np.ndarray, x: np.ndarray, qf: np.ndarray, xf: np.ndarray, s: Settings, own: np.ndarray) -> tuple | None:
    """What `range_search` needs to pass the audit; None if it does not."""
    adjacency, entries = build(xf, s)
    probe = np.unique(np.linspace(0, len(q) - 1, min(s.audit, len(q))).astype(int))
    truth = (q[probe] @ x.T >= s.radius) & (own[probe][:, None] != np.arange(len(x)))
    for beam in (s.beam, 2 * s.beam, 4 * s.beam, 8 * s.beam):
        audited = range_search(qf[probe], xf, adjacency, entries, s, beam)
        if (truth & (audited > s.radius - 1e-3)).sum() >= s.needed_recall * truth.sum():
            return adjacency, entries, s, beam
    return None


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root
    return root


FOUND = "entity long, vec long, links long, root long"


def _search(s: Settings):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entity", kind="stable")
        asks, holds = pdf["asks"].to_numpy(bool), pdf["holds"].to_numpy(bool)
        v = unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
        qi, xi = np.flatnonzero(asks), np.flatnonzero(holds)
        if not len(qi) or not len(xi):
            return pd.DataFrame({"entity": [], "vec": [], "links": [], "root": []}).astype("int64")
        own = np.full(len(pdf), -1)
        own[xi] = np.arange(len(xi))
        a, b = links_of(v[qi], v[xi], s, own[qi], int(pdf["blocks"].iloc[0]) == 1)
        a, b = qi[a], xi[b]
        entity = pdf["entity"].to_numpy(np.int64)
        other = entity[a] != entity[b]
        a, b = a[other], b[other]
        here = int(pdf["region"].iloc[0])
        lists = pdf["regions"].tolist()
        table = np.full((len(pdf), max(map(len, lists))), np.iinfo(np.int64).max)
        for i, r in enumerate(lists):
            table[i, : len(r)] = r
        counted = np.ones(len(a), bool)
        for at in range(0, len(a), 100_000):
            p, q = table[a[at : at + 100_000]], table[b[at : at + 100_000]]
            shared = (p[:, :, None] == q[:, None, :]).any(2)
            counted[at : at + 100_000] = np.where(shared, p, np.iinfo(np.int64).max).min(1) == here
        a, b = a[counted], b[counted]
        weight = pdf["weight"].to_numpy(np.int64)
        n = np.zeros(len(pdf), np.int64)
        np.add.at(n, a, weight[b])
        vec = pdf["vec"].to_numpy(np.int64)
        out = pd.DataFrame({"entity": entity, "vec": vec, "links": n, "root": vec[_roots(len(pdf), a, b)]})
        return out[asks | (out["root"] != out["vec"])]

    return run


def _regions(entities: DataFrame, s: Settings) -> DataFrame:
    """(entity, region, size): overlapping regions of every entity."""
    todo = entities.select("entity", "embedding", F.xxhash64("label", F.size("embedding"), F.lit(0)).alias("region"))
    done = None
    for level in range(s.levels + 1):
        sized = cut(todo.join(todo.groupBy("region").agg(F.count("*").alias("size")), "region"))
        columns = ("entity", "region", "size")
        ready = (sized if level == s.levels else sized.filter(F.col("size") <= s.region)).select(*columns)
        done = ready if done is None else done.unionByName(ready)
        big = sized.filter(F.col("size") > s.region)
        if level == s.levels or big.isEmpty():
            return done

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("entity")
            x = unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64)).astype(np.float32)
            c = apart(centroids(x, min(256, -(-int(pdf["size"].iloc[0]) * 3 // s.region))), reach(s.radius))
            copies = assign(x, c, s.radius).sum(1).mean()
            if copies * copies >= len(c):  # then the regions' pairs are no fewer than the group's
                c = c[:0]
            return pd.DataFrame({"region": np.full(len(c), pdf["region"].iloc[0]), "center": pd.Series(list(c), dtype=object)})

        chosen = big.filter(F.pmod(F.xxhash64("entity", F.lit(level)), F.col("size")) < s.sample)
        centers = cut(chosen.groupBy("region").applyInPandas(fit, "region long, center array<float>"))
        split = centers.select("region").distinct()
        done = done.unionByName(big.join(split, "region", "left_anti").select(*columns))
        big = big.join(split, "region", "left_semi")
        salted = big.withColumn("salt", F.pmod(F.xxhash64("entity"), F.ceil(F.col("size") / F.lit(float(s.sample)))))
        salts = salted.select("region", "salt").distinct()

        def place(vectors: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            if not len(vectors) or not len(near):
                return pd.DataFrame({"entity": [], "embedding": [], "region": [], "child": []})
            near = near.sort_values("rank")
            x = unit(np.stack(vectors["embedding"].to_numpy()).astype(np.float64)).astype(np.float32)
            i, j = np.nonzero(assign(x, np.stack(near["center"].to_numpy()).astype(np.float32), s.radius))
            return pd.DataFrame({"entity": vectors["entity"].to_numpy()[i], "embedding": vectors["embedding"].to_numpy()[i], "region": vectors["region"].to_numpy()[i], "child": j})

        ranked = centers.join(salts.toDF("of", "part"), F.col("region") == F.col("of")).select("of", "part", "center", F.xxhash64("center").alias("rank"))
        moved = salted.groupBy("region", "salt").cogroup(ranked.groupBy("of", "part")).applyInPandas(place, "entity long, embedding array<float>, region long, child long")
        todo = moved.select("entity", "embedding", F.xxhash64("region", "child", F.lit(level + 1)).alias("region"))
    return done


def _found(vectors: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, entities, search results)."""
    e = F.col("embedding")
    usable = F.col("label").isNotNull() & e.isNotNull() & (F.size("embedding") > 0)
    usable = usable & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = cut(vectors.select(F.col("vec_id").cast("long"), F.when(usable & F.col("vec_id").isNotNull(), e.cast("array<float>")).alias("embedding"), F.col("label").cast("string").alias("label")))
    alike = rows.filter("embedding is not null").groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec"))
    entities = cut(alike.withColumn("entity", F.monotonically_increasing_id()))
    regions = cut(_regions(entities, s))
    lists = regions.groupBy("entity").agg(F.sort_array(F.collect_set("region")).alias("regions"))
    members = regions.join(lists, "entity").join(entities.select("entity", "embedding", "weight", "vec"), "entity")
    blocks = F.ceil(F.col("size") / F.lit(float(s.region))).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    every = F.explode(F.expr("sequence(0, blocks - 1)")).alias("mate")
    asks = members.select("*", every).select("*", F.col("block").alias("q"), F.col("mate").alias("x"), (F.col("mate") == F.col("block")).alias("holds")).withColumn("asks", F.lit(True))
    holds = members.select("*", every).filter("mate <> block").select("*", F.col("mate").alias("q"), F.col("block").alias("x"), F.lit(True).alias("holds")).withColumn("asks", F.lit(False))
    found = asks.unionByName(holds).groupBy("region", "q", "x").applyInPandas(_search(s), FOUND)
    return rows, entities, cut(found)


def _audit(entities: DataFrame, counted: DataFrame, s: Settings) -> DataFrame:
    """One row: the share of links found among those that a fixed set of queries has with all entities of its label."""
    order = F.xxhash64("label", "embedding")
    asked = entities.select("entity", "label", "embedding").orderBy(order, "vec").limit(s.audited).toPandas()  # `audited` rows
    asked["width"] = asked["embedding"].map(len)
    groups = {k: (g["entity"].to_numpy(np.int64), unit(np.stack(g["embedding"].to_numpy()).astype(np.float64))) for k, g in asked.groupby(["label", "width"])}

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, g in pdf.groupby(["label", pdf["embedding"].map(len)]):
                if k in groups:
                    ids, q = groups[k]
                    link = q @ unit(np.stack(g["embedding"].to_numpy()).astype(np.float64)).T >= s.radius
                    link &= ids[:, None] != g["entity"].to_numpy(np.int64)
                    yield pd.DataFrame({"entity": ids, "truth": link @ g["weight"].to_numpy(np.int64)})

    truth = entities.select("entity", "label", "embedding", "weight").mapInPandas(links, "entity long, truth long").groupBy("entity").agg(F.sum("truth").alias("truth"))
    both = truth.join(counted, "entity", "left")
    return both.agg((F.sum(F.least("truth", F.coalesce("links", F.lit(0)))) / F.nullif(F.sum("truth"), F.lit(0))).alias("audited_recall"))


def near_vectors(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept and audited_recall of every row.

    Vectors of different lengths or labels never link. Rows that repeat a vec_id are rows of their own for n_links and one
    node for components. Rows with a null vec_id have no links and null component. An empty table gives an empty result;
    other columns are left out. audited_recall is the share of links found among those that a fixed set of queries has with
    all entities of its label, themselves excepted; null where they have none.
    """
    rows, entities, found = _found(vectors, s)
    counted = found.groupBy("entity").agg(F.sum("links").alias("links"))
    weighed = entities.join(counted, "entity", "left").select("label", "embedding", "vec", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    mine = rows.filter("embedding is not null").join(weighed, ["label", "embedding"])
    edges = found.select(F.col("vec").alias("a"), F.col("root").alias("b")).unionByName(mine.select(F.col("vec_id").alias("a"), F.col("vec").alias("b")))
    classes = components(edges)
    audit = _audit(entities, counted, s)
    out = mine.select("vec_id", "links").unionByName(rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long")).toDF("vec_id", "links"))
    out = out.join(classes, F.col("vec_id") == F.col("node"), "left").crossJoin(F.broadcast(audit))  # one row
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.col("links").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), "audited_recall")
