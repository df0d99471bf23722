"""Centroid clustering; the nearest centroid is found by progressive Walsh-Hadamard search.

Vectors become integers and are transformed by the (unnormalised, hence exact integer) Walsh-Hadamard
transform in sequency order.  By Parseval the squared differences of all coefficients add up to d times the squared
distance, and every partial sum is a lower bound.  A vector first meets all centroids on the coarsest coefficients; the most
promising one is finished at once and gives a bound; then blocks of finer coefficients are added for the centroids
left, and those strictly beyond the bound go.  Centroids that tie stay, so after the last block the smallest number among the
nearest is exact.

A round is one pass over the vectors: tasks keep integer sums per centroid and only these reach the driver (centroids x
components).  Nothing is cached, so a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import materialise

#: Scaled components reach up to this size; larger ones have no distance within a decimal(38,0).
LARGEST = 1 << 56
COARSE = 4  # coefficients that all centroids are compared on
PAIRS = 1 << 20  # numbers held at once in the coarse step


def sequency(d: int) -> np.ndarray:
    """Rows of the Hadamard matrix of order ``d`` (a power of two) from few to many sign changes."""
    i = np.arange(d)
    signs = np.array([[bin(r & c).count("1") & 1 for c in i] for r in i])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def walsh(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the integer rows of ``x``, padded with zeros to the order's length."""
    n, d = len(x), len(order)
    if x.shape[1] < d:
        x = np.concatenate([x, np.zeros((n, d - x.shape[1]), dtype=x.dtype)], axis=1)
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x[:, order]


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest row of ``c`` (ties: the first) for every row of ``v``, both transformed, and d times the squared distance."""
    n, d = v.shape
    first = min(COARSE, d)
    step = max(1, PAIRS // (len(c) * first))
    if n > step:
        parts = [nearest(v[i:i + step], c) for i in range(0, n, step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    some = ((v[:, None, :first] - c[None, :, :first]) ** 2).sum(axis=2)
    guess = some.argmin(axis=1)
    bound = some[np.arange(n), guess] + ((v[:, first:] - c[guess, first:]) ** 2).sum(axis=1)
    row, cand = np.nonzero(some <= bound[:, None])
    total, low = some[row, cand], first
    while low < d:
        high = min(2 * low, d)
        total = total + ((v[row, low:high] - c[cand, low:high]) ** 2).sum(axis=1)
        keep = (total <= bound[row]).astype(bool)
        row, cand, total, low = row[keep], cand[keep], total[keep], high
    starts = np.searchsorted(row, np.arange(n))  # every row keeps at least the centroid that gave its bound
    best = np.minimum.reduceat(total, starts)
    hit = np.flatnonzero((total == best[row]).astype(bool))
    hit = hit[np.searchsorted(row[hit], np.arange(n))]  # candidates ascend inside a row
    return cand[hit], best


class _Search:
    """Assignment of Arrow batches to fixed centroids (lists of integers)."""

    def __init__(self, centroids: list[list[int]], dim: int):
        width = 1 << max(dim - 1, 0).bit_length()
        self.order, self.width = sequency(width), width
        self.safe = 1 << (62 // 2 - width.bit_length())  # below it, d squared differences fit into a long
        self.plain = all(abs(x) < self.safe for c in centroids for x in c)
        self.exact = walsh(np.array(centroids, dtype=object), self.order)
        self.fast = self.exact.astype(np.int64) if self.plain else None

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Integer rows, clusters and squared distances."""
        q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        if self.plain and np.abs(q).max() < self.safe:
            cluster, total = nearest(walsh(q, self.order), self.fast)
        else:
            q = q.astype(object)
            cluster, total = nearest(walsh(q, self.order), self.exact)
        return q, cluster, total // self.width


def _decimals(x) -> pa.Array:
    return pa.array([Decimal(int(y)) for y in x], pa.decimal128(38, 0))


def _sums(search: _Search, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for b in batches:
            if b.num_rows:
                q, cluster, _ = search(b)
                for j in np.unique(cluster):
                    mine = q[cluster == j]
                    add = [len(mine)] + [int(x) for x in mine.sum(axis=0)]
                    held[int(j)] = [x + y for x, y in zip(held[int(j)], add)] if int(j) in held else add
        for j, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * (dim + 1), pa.int32()), pa.array(range(dim + 1), pa.int32()), _decimals(sums)], ["cluster", "i", "x"])

    return run


def _assign(search: _Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, cluster, distance = search(b)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), _decimals(distance)], ["vec_id", "cluster", "distance"])

    return run


def scaled_rows(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """``vec_id, q`` with q = floor(scale * x) of the vectors with ``dim`` finite parts, all smaller than ``LARGEST`` when scaled."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double") * F.lit(float(scale)))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float(LARGEST))), F.lit(False)))
    return (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("v"))
            .filter(F.col("v").isNotNull() & (F.size("v") == dim)).filter(fine)
            .select("vec_id", F.transform("v", lambda x: F.floor(x).cast("bigint")).alias("q")))


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1",
                    id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256`` for every vector kept.

    Kept are vectors with exactly ``dim`` components, none NULL or non-finite, as integers floor(scale * x) (sizes of 2^56 or
    more take no part either).  Centroids start as the ``k`` kept vectors (all, if fewer) with the smallest lowercase-hex
    SHA-256 of ``seed:vec_id``; equal ids are ordered by their vectors, and a NULL id comes last.  Each round
    assigns every vector to the nearest centroid (squared Euclidean, ties to the smaller number) and replaces every
    non-empty centroid by the floor of its vectors' mean; empty ones stay.  A last assignment gives the result.
    Repeated rows count and are returned as often as they occur; distances and inertias are exact ``decimal(38,0)``.  Other
    columns are ignored; an empty table gives an empty result.
    """
    if k < 1 or dim < 1 or rounds < 0:
        raise ValueError("k and dim must be positive, rounds not negative")
    rows = scaled_rows(vectors, id_col, vec_col, dim, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["q"]) for r in rows.orderBy(digest.asc_nulls_last(), "q").limit(k).collect()]  # k rows
    for _ in range(rounds if centroids else 0):
        sums: dict[int, dict[int, int]] = {}
        for r in (rows.mapInArrow(_sums(_Search(centroids, dim), dim), "cluster int, i int, x decimal(38,0)")
                  .groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect()):  # k x (dim + 1) rows
            sums.setdefault(r["cluster"], {})[r["i"]] = int(r["x"])
        centroids = [[sums[j][i + 1] // sums[j][0] for i in range(dim)] if j in sums else c for j, c in enumerate(centroids)]
    found = materialise(rows.mapInArrow(_assign(_Search(centroids or [[0] * dim], dim)), "vec_id bigint, cluster int, distance decimal(38,0)"), "clusters")
    inertia = {r["cluster"]: r["x"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}  # k rows
    text = [",".join(map(str, c)) for c in centroids]
    known = vectors.sparkSession.createDataFrame(
        [(j, inertia[j], sum(inertia.values()), c, hashlib.sha256(text[j].encode()).hexdigest()) for j, c in enumerate(centroids) if j in inertia],
        "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<bigint>, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
