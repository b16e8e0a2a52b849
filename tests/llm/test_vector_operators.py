"""Exact top-k, whitening and hard negatives against brute force, with odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm import hard_negatives, pivot_search, whitening
from barflow.llm.vectors import LARGEST

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """Extra columns clash with inner names."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, entity int, v string, rank int")


@pytest.fixture(scope="module")
def rows():
    """Clusters, one vector that many rows share, ties, rows that repeat, and rows that take no part."""
    r = np.random.default_rng(2)
    x = r.normal(size=(260, 12)) / 3
    x = np.concatenate([x, x[:40] + r.normal(size=(40, 12)) / 50, x[:1].repeat(90, 0), -x[:10], np.zeros((3, 12))]).astype(np.float32)
    out = [(i, v.tolist(), int(i * 7 % 4) if i % 31 else None) for i, v in enumerate(x)]
    out += out[100:103] + out[:2] + out[350:352]
    n = len(out)
    out += [(n + 100, None, 1), (n + 101, [NAN] * 12, 1), (n + 102, [INF] + [0.0] * 11, 1), (n + 103, [None] * 12, 1), (None, x[0].tolist(), 1), (n + 104, [1.0, 2.0], 1), (n + 105, [], 1)]
    return out


def usable(rows, scale):
    kept = [r for r in rows if r[0] is not None and r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    width = max(len(r[1]) for r in kept)
    v = np.array([[np.floor(scale * float(c)) for c in r[1]] + [0] * (width - len(r[1])) for r in kept]).astype(np.int64)
    return np.array([r[0] for r in kept]), v, [r[2] for r in kept]


def nearest(ids, v, queries, k):
    out = []
    for i in queries:
        score = v @ v[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out += [(int(ids[i]), rank + 1, int(ids[j]), int(score[j])) for rank, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("s", [pivot_search.Settings(), pivot_search.Settings(pivots=5, sample=50, shard=40, queries=7, chunk=4, salts=3)])
def test_top_k_equals_brute_force(spark, rows, s):
    ids, v, _ = usable(rows, 1024)
    got = pivot_search.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, k=10, s=s)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == nearest(ids, v, np.flatnonzero(ids % 10 == 0), 10)


def test_top_k_of_few_rows(spark):
    few = [(0, [1.0, 0.0], 1), (1, [0.5, 2.0], 1), (2, [1e30, -1e30], 1)]
    got = sorted(map(tuple, pivot_search.top_k(table(spark, few), F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 2, 1024 * LARGEST), (0, 2, 1, 512 * 1024)]
    assert pivot_search.top_k(table(spark, few), F.col("vec_id") == 9).count() == 0
    assert pivot_search.top_k(table(spark, []), F.col("vec_id") == 0).count() == 0
    assert pivot_search.top_k(table(spark, few[:1]), F.col("vec_id") == 0).count() == 0


def test_elimination_keeps_the_best():
    """Two clusters far apart, small chunks: the scan stops early and is still exact."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(150, 8)) / 40 + np.eye(8)[0], r.normal(size=(150, 8)) / 40 - np.eye(8)[0]]).astype(np.float32)
    ids, v, _ = usable([(i, row.tolist(), 0) for i, row in enumerate(x)], 1024)
    high = pivot_search.heights(v, float((v * v).sum(1).max()))
    longest = float((v * v).sum(1).max())
    p = pivot_search.pick_pivots(v, high, 16)
    dist = pivot_search.distances(v, high, v[p], high[p])
    q_dist = pivot_search.distances(v[:5], np.zeros(5), v[p], high[p])
    for i, places, scores in pivot_search.best(v[:5], q_dist, np.full(5, -np.inf), v, dist, ids, longest, 6, pivot_search.Settings(chunk=4)):
        exact = v @ v[i]
        assert places.tolist() == np.lexsort((ids, -exact))[:6].tolist() and scores.tolist() == exact[places].tolist()
    assert len(set(p.tolist())) == len(p)


def mined(ids, v, label, anchors, positives=5, negatives=3):
    out = []
    alike = np.array([[a is not None and a == b for b in label] for a in label])
    part = np.array([a is not None for a in label])
    for i in anchors:
        if not part[i]:
            continue
        score = v @ v[i]
        order = np.lexsort((ids, -score))
        for p in [j for j in order if alike[i, j] and j != i][:positives]:
            fits = [j for j in order if part[j] and not alike[i, j] and 50 * score[p] <= 100 * score[j] <= 95 * score[p]][:negatives]
            out += [(int(ids[i]), int(ids[p]), k + 1, int(ids[j]), int(score[p]), int(score[j])) for k, j in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("s", [hard_negatives.Settings(), hard_negatives.Settings(shard=60, block=9, step=3, salts=2)])
def test_hard_negatives_equal_brute_force(spark, rows, s):
    ids, v, label = usable(rows, 256)
    got = hard_negatives.mine(table(spark, rows), F.col("label"), F.col("vec_id") % 5 == 0, s=s)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(ids, v, label, np.flatnonzero(ids % 5 == 0))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_hard_negatives_of_few_rows(spark):
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.75, 0.0], 2), (3, [0.25, 0.0], 2), (4, [0.95, 9.0], None), (5, [-1.0, 0.0], 3)]
    got = hard_negatives.mine(table(spark, few), F.col("label"), F.col("vec_id").isin(0, 2, 5)).collect()
    # 3 is the only positive of 2, with the score 48 * 16: no other label has between half and 95 % of it
    assert list(map(tuple, got)) == [(0, 1, 1, 2, 65536, 49152)]
    assert hard_negatives.mine(table(spark, []), F.col("label"), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(table(spark, few), F.col("label"), F.col("vec_id") == 77).count() == 0


def whole(x, rows_x, components=16):
    n, total = len(x), x.sum(0)
    c = x - total / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return e, u, (rows_x - total / n) @ u / np.sqrt(e), ((n * rows_x - total) ** 2).sum(1)


def test_whitening_equals_the_dense_solution(spark):
    r = np.random.default_rng(3)
    x = (r.normal(size=(400, 24)) * np.linspace(1, 3, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(i, x[0].tolist(), 0) for i in range(400, 700)] + [(3, x[3].tolist(), 0), (None, x[5].tolist(), 0)]
    odd = [(1000, None, 0), (1001, [NAN] * 24, 0), (1002, [-INF] + [1.0] * 23, 0), (1003, [None] * 24, 0)]
    rows_x = np.floor(64 * np.array([v for _, v, _ in rows], float)).astype(np.int64) + 1_000_000
    e, _, want, deviation = whole(np.unique(rows_x, axis=0), rows_x)
    got = whitening.whiten(table(spark, rows + odd)).toPandas()
    assert len(got) == 16 * len(rows) and (got["n"] == 400).all() and got["identity_error"].max() < 1e-12 and got["residual"].max() < 1e-13
    first = got[got["component"] == 1]
    assert sorted(first["deviation"]) == sorted(deviation.tolist())
    by_id = got[got["vec_id"] < 1000].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((by_id[:400] * want[:400]).sum(0))
    assert np.abs(by_id * sign - want[:700]).max() < 1e-9
    explained = got.groupby("component")["explained"].first().to_numpy()
    c = np.unique(rows_x, axis=0)
    assert np.allclose(explained, e / ((c - c.mean(0)) ** 2).sum() * len(c), rtol=1e-10)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [], 0)])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 0)] * 3)).count() == 0  # no variance
    # shorter vectors are filled up; five distinct vectors have at most four components
    five = [(i, [float(i % 5), float(i * i % 5)] + [float(i % 5 == 2)] * (i % 2), 0) for i in range(10)]
    got = whitening.whiten(table(spark, five)).toPandas()
    assert len(got) == 10 * got["component"].max() and got["component"].max() == 3 and got["identity_error"].max() < 1e-12


def test_deviations_beyond_a_long():
    sums = np.array([0, 0], object)
    assert whitening.deviations(np.array([[2**20, 1]]), 2**10, sums) == [2**60 + 2**20]
    assert whitening.deviations(np.array([[2**26, 0], [1, 0]]), 2**10, sums) == [None, 2**20]
    assert whitening.deviations(np.array([[2**40, 0]]), 2**30, np.array([2**70 - 3, 0], object)) == [9]


@pytest.mark.parametrize("spectrum", [[5.0] * 4 + [1.0] * 30, list(range(1, 41)), [1e6, 1.0, 1.0, 1e-6] + [0.0] * 20, [2.0, 1.0]])
def test_eigenpairs(spectrum):
    r = np.random.default_rng(7)
    q = np.linalg.qr(r.normal(size=(len(spectrum),) * 2))[0]
    v = (q * spectrum) @ q.T
    e, u, residual = whitening.eigenpairs(lambda b: v @ b, len(spectrum), 8)
    top = max(spectrum)
    assert np.abs(e - sorted(spectrum, reverse=True)[:8]).max() < 1e-13 * top and residual.max() < 1e-13
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13 and np.abs(v @ u - u * e).max() < 1e-12 * top
