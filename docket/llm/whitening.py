"""Embedding whitening by a block Jacobi-Davidson iteration on the covariance, which is never formed.

The only access to the covariance V of the integer vectors x is the product V U with a narrow block U: one pass over the
vectors, each centred first, whose tasks return sums of the block's size.  The iteration keeps an orthonormal basis and its
image.  Rayleigh-Ritz on it gives the wanted pairs; a pair whose residual has reached double precision is locked (it stays in
the basis and takes no more corrections); for all others the projected correction equations

    (I - X X')(V - theta I)(I - X X') t = -r        X: the locked vectors and the pair's own

are solved by a few MINRES steps, side by side, so that a step costs one pass for all of them.  The corrections expand the
basis, which restarts from its best Ritz vectors when it gets wide.  Locked pairs are checked with a fresh product at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import materialise

EPS = float(np.finfo(float).eps)
LARGEST = 1 << 53  # scaled components up to here are exact doubles
INNER = 12  # MINRES steps of one correction at most
OUTER = 300  # expansions after which the nearest pairs so far are returned (residuals are part of the result)


def minres(op: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, target: float) -> np.ndarray:
    """MINRES for every column of ``b`` at once; ``op`` maps a block to the block of its images.  Ends when every
    column's residual fell by ``target`` or after ``steps`` steps."""
    def over(a, c):
        return np.divide(a, c, out=np.zeros_like(a), where=c > 0)

    beta = np.linalg.norm(b, axis=0)
    eta, first = beta.copy(), beta.copy()
    v, v_old = over(b, np.broadcast_to(beta, b.shape)), np.zeros_like(b)
    x, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    cos, cos_old, sin, sin_old = (np.full(b.shape[1], f) for f in (1.0, 1.0, 0.0, 0.0))
    beta = np.zeros_like(beta)
    for _ in range(steps):
        if (np.abs(eta) <= target * first).all():
            break
        u = op(v)
        alpha = (v * u).sum(axis=0)
        u = u - alpha * v - beta * v_old
        new = np.linalg.norm(u, axis=0)
        new[new <= 4 * EPS * (np.abs(alpha) + beta)] = 0.0  # the Krylov space is exhausted
        delta = cos * alpha - cos_old * sin * beta
        r1, r2, r3 = np.hypot(delta, new), sin * alpha + cos_old * cos * beta, sin_old * beta
        w, w_old = over(v - r3 * w_old - r2 * w, np.broadcast_to(r1, v.shape)), w
        cos_old, cos, sin_old, sin = cos, over(delta, r1), sin, over(new, r1)
        x = x + cos * eta * w
        eta = -sin * eta
        v_old, v, beta = v, over(u, np.broadcast_to(new, u.shape)), new
    return x


def _orthonormal(t: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns spanning what ``t`` adds to ``basis``; columns that add nothing go."""
    kept: list[np.ndarray] = []
    for col in t.T:
        size = np.linalg.norm(col)
        if size == 0 or not np.isfinite(size):
            continue
        col = col / size
        for _ in range(3):
            against = np.column_stack([basis, *kept]) if kept else basis
            col = col - against @ (against.T @ col)
            size = np.linalg.norm(col)
            if size < 1e-8:
                break
            col = col / size
        else:
            kept.append(col)
    return np.column_stack(kept) if kept else np.zeros((len(t), 0))


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and their images."""
    h = basis.T @ image
    theta, y = np.linalg.eigh((h + h.T) / 2)
    return theta[::-1], basis @ y[:, ::-1], image @ y[:, ::-1]


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric positive ``product`` on ``d`` numbers, their unit vectors (columns), and the residual norms.

    Ends when every residual is within rounding of the largest eigenvalue (4 d eps), or no longer falls there.
    """
    k = min(k, d)
    basis = _orthonormal(np.random.default_rng(7).normal(size=(d, min(d, 2 * k))), np.zeros((d, 0)))
    image = product(basis)
    widest, best, still = min(d, max(6 * k, 24)), np.inf, 0
    for outer in range(OUTER):
        theta, vectors, images = _ritz(basis, image)
        rest = images[:, :k] - vectors[:, :k] * theta[:k]
        norms = np.linalg.norm(rest, axis=0)
        goal = 4 * d * EPS * max(theta[0], 0.0)
        still = still + 1 if norms.max() > best / 2 else 0
        best = min(best, norms.max())
        open_ = np.flatnonzero(norms > goal)
        full = basis.shape[1] == d
        if not len(open_) or full or (still >= 3 and best <= 1e3 * goal):  # nothing left to add: check with a fresh product
            fresh = product(vectors[:, :k])
            small = vectors[:, :k].T @ fresh
            theta_k, y = np.linalg.eigh((small + small.T) / 2)
            theta_k, x, ax = theta_k[::-1], vectors[:, :k] @ y[:, ::-1], fresh @ y[:, ::-1]
            norms = np.linalg.norm(ax - x * theta_k, axis=0)
            if norms.max() <= goal or full or still >= 3 or outer == OUTER - 1:
                return np.maximum(theta_k, 0.0), x, norms
            basis, image = vectors, images.copy()
            image[:, :k] = fresh
            continue
        if basis.shape[1] + len(open_) > widest:
            basis, image = vectors[:, :2 * k], images[:, :2 * k]
        locked = vectors[:, np.setdiff1d(np.arange(k), open_)]
        own, shift = vectors[:, open_], theta[open_]

        def project(t):
            t = t - locked @ (locked.T @ t)
            return t - own * (own * t).sum(axis=0)

        t = minres(lambda v: project(product(project(v)) - shift * project(v)), project(-rest[:, open_]), INNER, 0.5 ** (outer + 2))
        new = _orthonormal(np.column_stack([project(t), rest[:, open_]]), basis)[:, :max(1, min(len(open_), d - basis.shape[1]))]
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(outer).normal(size=(d, 1)), basis)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    theta, vectors, images = _ritz(basis, image)
    return np.maximum(theta[:k], 0.0), vectors[:, :k], np.linalg.norm(images[:, :k] - vectors[:, :k] * theta[:k], axis=0)


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """``vec_id, x`` with x = floor(scale * c) + shift of the vectors without NULL, non-finite or huge (2^53 and more when scaled) parts."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double") * F.lit(float(scale)))
    fine = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float(LARGEST))), F.lit(False)))
    return (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull()).filter(fine)
            .select("vec_id", F.transform("v", lambda c: F.floor(c).cast("bigint") + F.lit(shift).cast("bigint")).alias("x")))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


class Moments:
    """Number of rows and exact sums; maps integer rows to centred doubles and to exact deviations."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = [s // n for s in sums]
        self.low = np.array(self.base, dtype=np.int64)
        self.rest = np.array([s - n * b for s, b in zip(sums, self.base)], dtype=object)
        self.part = np.array([r / n for r in self.rest], dtype=float)  # true quotients of integers

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low).astype(float) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exact."""
        y = x - self.low
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if x.shape[1] * largest * largest < 1 << 62:
            z = self.n * y - self.rest.astype(np.int64)
        else:
            z = self.n * y.astype(object) - self.rest
        return [int(s) for s in (z * z).sum(axis=1)]


def _rows(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(values.size, dtype=np.int32)), pa.array(values.reshape(-1))], ["i", "x"])


def _added(rows: DataFrame, run, size: int) -> np.ndarray:
    """Sum over all tasks of what each returns as (i, x); ``size`` numbers reach the driver."""
    out = np.zeros(size)
    for r in rows.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out


def _first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        if b.num_rows:
            x = _matrix(b)
            wide = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
            add = [len(x), *map(int, (x.astype(object) if wide else x).sum(axis=0))]
            total = add if total is None else [p + q for p, q in zip(total, add)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "x"])


def covariance_product(rows: DataFrame, m: Moments, u: np.ndarray) -> np.ndarray:
    """V U over all rows, centred before multiplying, divisor n: one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                y = m.centred(_matrix(b))
                add = y.T @ (y @ u)
                total = add if total is None else total + add
        if total is not None:
            yield _rows(total)

    return _added(rows, run, u.size).reshape(u.shape) / m.n


def fit_moments(rows: DataFrame) -> Moments | None:
    got = {r["i"]: int(r["x"]) for r in rows.mapInArrow(_first_sums, "i int, x decimal(38,0)").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    return Moments(got[0], [got[i] for i in range(1, len(got))]) if got else None


RESULT = ("vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double, "
          "eigenvalue double, residual double")


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue, residual``.

    Vectors that are NULL or hold NULL or non-finite parts (or parts of 2^53 and more when scaled) take no part; if lengths differ,
    neither do those of any length but the most frequent (ties: the longest).  The others become x = floor(scale * c) + shift;
    all of them are the fit list.  Components count from 1 by falling eigenvalue of the covariance of x (divisor n); there are
    ``components`` of them, or as many as dimensions.  ``whitened`` is the centred x projected on the component, over the root of its
    eigenvalue; ``explained`` the eigenvalue's share of the trace; ``identity_error`` the largest entry of the whitened
    rows' covariance minus the identity; ``deviation`` is exact (NULL beyond 38 digits); ``residual`` is the norm that the iteration ended with.
    A component without variance has NULL ``whitened`` and takes no part in ``identity_error``; without any
    variance ``explained`` and ``identity_error`` are NULL.  Repeated rows count and are returned as often as they occur, NULL ids are
    kept; other columns are ignored; an empty table gives an empty result.
    """
    if components < 1:
        raise ValueError("components must be positive")
    spark = vectors.sparkSession
    rows = integer_rows(vectors, id_col, vec_col, scale, shift)
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None or not length["d"]:
        return spark.createDataFrame([], RESULT)
    d = length["d"]
    rows = materialise(rows.filter(F.size("x") == d), "integer-vectors")  # read once a pass
    m = fit_moments(rows)
    values, axes, residual = jacobi_davidson(lambda u: covariance_product(rows, m, u), d, components)
    k = len(values)
    live = np.flatnonzero(values > 4 * d * EPS * values[0])
    turn = axes[:, live] / np.sqrt(values[live])
    c = len(live)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the whitened rows, of their products, and the trace."""
        total = np.zeros(c + c * c + 1)
        for b in batches:
            if b.num_rows:
                y = m.centred(_matrix(b))
                w = y @ turn
                total += np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1), [(y * y).sum()]])
        yield _rows(total)

    got = _added(rows, check, c + c * c + 1) / m.n
    error = float(np.abs(got[c:-1].reshape(c, c) - np.outer(got[:c], got[:c]) - np.eye(c)).max()) if c else None
    explained = [float(v / got[-1]) if got[-1] > 0 else None for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b)
            w = np.full((len(x), k), np.nan)
            w[:, live] = m.centred(x) @ turn
            at = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array([Decimal(s) if s < 10**38 else None for s in m.deviations(x)], pa.decimal128(38, 0))
            each = np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(at), pa.array(each + 1, pa.int32()), pa.array(np.full(len(each), m.n)), deviation.take(at),
                 pa.array(w.reshape(-1), from_pandas=True), pa.array(explained, pa.float64()).take(pa.array(each)),
                 pa.array([error] * len(each), pa.float64()), pa.array(values[each]), pa.array(residual[each])],
                [f.split()[0] for f in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)
