"""Whitening by the leading eigenvectors of the covariance, found by Jacobi-Davidson.

The covariance is never formed: a product with a block of vectors is one pass over the distinct integer vectors, each centred
before it is multiplied, and only (dimensions x block) sums leave a task. A search space is expanded by the solutions of the
projected correction equations, which inner MINRES recurrences, one per open pair, solve with shared passes. Rayleigh-Ritz in the
space gives the pairs; a pair whose residual has reached double precision is locked, and the space goes on orthogonal to it.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.vectors import finite, integers, padded, stored


@dataclasses.dataclass(frozen=True)
class Settings:
    #: vectors in the first search space beyond the wanted ones
    extra: int = 8
    #: passes of the inner solver
    inner: int = 6
    #: the search space starts again from its best vectors beyond this many times the wanted ones
    widest: int = 6
    outer: int = 200
    #: sums that reach the driver; more tasks than that are added up by tasks first
    partials: int = 64
    seed: int = 5


EPS = float(np.finfo(float).eps)


def rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An array column without nulls as a matrix of long."""
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


class Fit:
    """The distinct vectors, their number n and their sums, and passes over them."""

    def __init__(self, table: DataFrame, s: Settings):
        self.table, self.s = table, s
        self.spark = table.sparkSession
        self.n = table.count()
        self.dims = (table.select(F.size("x")).first() or [0])[0]
        self.sums = self._sums() if self.n else np.zeros(0, object)

    def _sums(self) -> np.ndarray:
        def add(batches):
            total = None
            for b in batches:
                x = rows_of(b, "x")
                if len(x):
                    part = x.sum(0)  # a batch of 2^26 at most each
                    total = part.astype(object) + (0 if total is None else total)
            if total is not None:
                yield pa.RecordBatch.from_pydict({"dim": list(range(len(total))), "total": list(map(str, total))}, schema=pa.schema([("dim", pa.int32()), ("total", pa.string())]))

        parts = self.table.select("x").mapInArrow(add, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        return np.array([int(r["total"]) for r in parts.orderBy("dim").collect()], object)  # a row per dimension

    def total(self, fn, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of fn(centred rows) over all vectors; fn returns an array of this shape."""
        n, sums = self.n, self.sums

        def run(batches):
            out = np.zeros(shape)
            for b in batches:
                x = rows_of(b, "x")
                for at in range(0, len(x), 4096):
                    out += fn(centred(x[at : at + 4096], n, sums))
            yield pa.RecordBatch.from_pydict({"part": [out.tobytes()]}, schema=pa.schema([("part", pa.binary())]))

        def join(key, pdf):
            import pandas as pd

            return pd.DataFrame({"part": [np.sum([np.frombuffer(p) for p in pdf["part"]], axis=0).tobytes()]})

        parts = self.table.select("x").mapInArrow(run, "part binary")
        if self.table.rdd.getNumPartitions() > self.s.partials:
            parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(self.s.partials))).applyInPandas(join, "part binary")
        found = [np.frombuffer(r["part"]) for r in parts.collect()]  # at most `partials` blocks
        return np.sum(found, axis=0).reshape(shape)

    def times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times a block of vectors."""
        return self.total(lambda c: c.T @ (c @ block), block.shape) / self.n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n from the integers n * x - S, so that only the last division rounds."""
    return differences(x, n, sums).astype(np.float64) / n


def differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, as long where that is sure to fit."""
    top = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if 2 * top < 2**63:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum of squares of every row's differences; None where a long does not hold it."""
    d = differences(x, n, sums)
    top = max(map(abs, map(int, (d.min(initial=0), d.max(initial=0)))))
    if top * top * max(d.shape[1], 1) < 2**63:
        return (d.astype(np.int64) ** 2).sum(1).tolist()
    return [v if v < 2**63 else None for v in (int(r) for r in (d.astype(object) ** 2).sum(1))]


def _orthogonal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The part of t outside the bases as orthonormal columns; directions that are lost to rounding are left out."""
    size = np.sqrt((t * t).sum(0))
    t = t[:, size > 0] / size[size > 0]
    for _ in range(2):
        for b in bases:
            t = t - b @ (b.T @ t)
    kept = np.zeros((len(t), 0))
    for c in t.T:
        for _ in range(2):
            for b in (*bases, kept):
                c = c - b @ (b.T @ c)
        norm = np.sqrt(c @ c)
        if norm > 1e-10:
            c = c / norm
            for b in (*bases, kept):
                c = c - b @ (b.T @ c)
            kept = np.column_stack([kept, c / np.sqrt(c @ c)])
    return kept


def minres(times, theta: np.ndarray, rhs: np.ndarray, basis: np.ndarray, steps: int) -> np.ndarray:
    """Solutions of (I - QQ')(V - theta)(I - QQ') t = rhs for every column at once, t orthogonal to Q = basis.

    Lanczos recurrences with Givens rotations run side by side and share each product with V.
    """
    out = lambda y: y - basis @ (basis.T @ y)
    r = out(rhs)
    beta = np.sqrt((r * r).sum(0))
    x = np.zeros_like(r)
    if not beta.max(initial=0) > 0:
        return x
    old, v = np.zeros_like(r), r / np.where(beta > 0, beta, 1)
    w_old, w = np.zeros_like(r), np.zeros_like(r)
    c_old, s_old, c, s = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    eta, last = beta.copy(), np.zeros_like(beta)
    live = beta > 0
    for _ in range(steps):
        p = out(times(v) - theta * v)
        alpha = (p * v).sum(0)
        p = p - alpha * v - last * old
        after = np.sqrt((p * p).sum(0))
        delta = c * alpha - c_old * s * last
        rho1 = np.sqrt(delta * delta + after * after)
        rho2 = s * alpha + c_old * c * last
        rho3 = s_old * last
        live &= rho1 > 0
        safe = np.where(live, rho1, 1)
        c_old, s_old, c, s = c, s, np.where(live, delta / safe, 1), np.where(live, after / safe, 0)
        w_old, w = w, (v - rho3 * w_old - rho2 * w) / safe
        x = x + np.where(live, c * eta, 0) * w
        eta = -s * eta
        live &= after > 1e-14 * beta
        old, v, last = v, p / np.where(live, after, 1), np.where(live, after, 0)
        if not live.any():
            break
    return out(x)


def eigenpairs(times, dims: int, wanted: int, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals relative to the largest value) of the `wanted` largest eigenvalues, falling.

    Pairs are locked from the top only, so no pair is passed over. A residual counts as double precision below 16 eps times the
    root of the dimension, or once it has stopped falling within sixteen times that.
    """
    wanted = min(wanted, dims)
    r = np.random.default_rng(s.seed)
    locked, values = np.zeros((dims, 0)), []
    space = _orthogonal(r.normal(size=(dims, min(dims, wanted + s.extra))))
    image = times(space)
    tight, before = 16 * EPS * dims**0.5, np.inf
    for _ in range(s.outer):
        h = space.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        top = max([*values[:1], abs(theta[0]) if len(theta) else 0.0])
        left = min(wanted - len(values), len(theta))
        u, vu = space @ y, image @ y
        residual = vu[:, :left] - theta[:left] * u[:, :left]
        # the image of a locked vector is its multiple, up to rounding
        residual = residual - locked @ (locked.T @ residual)
        size = np.sqrt((residual * residual).sum(0)) / (top or 1.0)
        worst = size.max(initial=0)
        limit = tight if worst < before / 2 else 16 * tight
        before = worst
        done = 0
        while done < left and size[done] <= limit:
            done += 1
        if done:
            locked = np.column_stack([locked, u[:, :done]])
            values += theta[:done].tolist()
            before = np.inf
        if len(values) >= wanted:
            break
        # what stays of the space is orthogonal to the locked vectors, as these are Ritz vectors of it
        space, image = u[:, done:], vu[:, done:]
        if space.shape[1] > s.widest * wanted:
            space, image = space[:, : 2 * wanted], image[:, : 2 * wanted]
        active = residual[:, done:]
        near = u[:, done:left]
        solved = minres(times, theta[done:left], -active, np.column_stack([locked, near]), s.inner)
        grown = _orthogonal(np.column_stack([solved, active]) if space.shape[1] + 2 * solved.shape[1] <= dims else solved, locked, space)
        if not grown.shape[1]:
            grown = _orthogonal(r.normal(size=(dims, 1)), locked, space)
        if grown.shape[1]:
            space, image = np.column_stack([space, grown]), np.column_stack([image, times(grown)])
        else:
            image = times(space)  # the space is whole: fresh products, then Rayleigh-Ritz again
    else:
        raise RuntimeError("an eigenpair did not reach double precision")
    # one last Rayleigh-Ritz over the locked vectors with fresh products
    vectors = np.linalg.qr(locked)[0]
    image = times(vectors)
    h = vectors.T @ image
    theta, y = np.linalg.eigh((h + h.T) / 2)
    theta, vectors, image = theta[::-1], vectors @ y[:, ::-1], image @ y[:, ::-1]
    rest = image - vectors * theta
    return theta, vectors, np.sqrt((rest * rest).sum(0)) / (abs(theta[0]) or 1.0)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, s: Settings = Settings()) -> DataFrame:
    """For every row and component its projection on the component over the root of its variance, with the fit's figures.

    x = floor(scale * c) + offset of every entry c. The fit counts each distinct x vector once; n is their number, S their sums,
    deviation the exact sum of (n * x - S)^2, null where a long does not hold it. Rows whose vector is null or holds null or
    non-finite entries are left out; rows that repeat are rows of their own; a null vec_id stays null; shorter vectors are filled
    up with zeros; scaled entries beyond 2^26 count as 2^26. Components are numbered from 1 by falling eigenvalue; those of
    variance zero cannot be whitened and are left out, so a single distinct vector gives no rows, as does an empty table. Equal
    eigenvalues: any orthonormal vectors of their space, the same for all rows. `residual` is the component's |Vu - eu| over
    the largest eigenvalue. Other columns are left out.
    """
    rows = vectors.filter(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("x"))
    rows = padded(stored(rows), "x").select("vec_id", F.transform("x", lambda v: v.cast("long") + offset).alias("x"))
    fit = Fit(stored(rows.select("x").distinct()), s)
    n, sums, dims = fit.n, fit.sums, fit.dims
    empty = vectors.sparkSession.createDataFrame([], SCHEMA)
    if not n or not dims:
        return empty
    trace = fit.total(lambda c: np.array([(c * c).sum()]), (1,))[0] / n
    if not trace > 0:
        return empty
    values, basis, residual = eigenpairs(fit.times, dims, components, s)
    kept = int((values > 64 * EPS * dims * values[0]).sum())
    values, basis, residual = values[:kept], basis[:, :kept], residual[:kept]
    scaled = basis / np.sqrt(values)
    mean = fit.total(lambda c: (c @ scaled).sum(0), (kept,)) / n

    def spread(c):
        w = c @ scaled - mean
        return w.T @ w

    error = float(np.abs(fit.total(spread, (kept, kept)) / n - np.eye(kept)).max())

    def project(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("w", pa.list_(pa.float64()))])
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = rows_of(part, "x")
                w = centred(x, n, sums) @ scaled
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviations(x, n, sums), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], schema=schema)

    out = rows.mapInArrow(project, "vec_id long, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("pos", "whitened"))
    part = F.col("pos") + 1
    listed = lambda v: F.element_at(F.array(*map(F.lit, v)), part)
    return out.select("vec_id", part.cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", listed((values / trace).tolist()).alias("explained"), F.lit(error).alias("identity_error"), listed(residual.tolist()).alias("residual"))
