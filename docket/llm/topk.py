"""Exact top-k search by inner product over a pivot-distance index.

Index: every vector is keyed by its nearest pivot and its distance to that
pivot; the key order is cut into slabs (one pivot, a range of distances).  At
most about ``MAX_SLABS`` slabs exist whatever the size of the table, so their
bounds fit on the driver.  Search: the slab a query would fall into, and the
slab that promises most, give a first k-th score; then only slabs whose
triangle-inequality bound reaches that score are expanded, annulus by annulus
in the order of their bounds, until no annulus can beat the k-th score.

For a pivot p and vectors v with r0 <= |v-p| <= r1 and |v| <= M:

* q.v = q.p + q.(v-p) <= q.p + |q| r1
* |q-v| >= g = max(0, |q-p|-r1, r0-|q-p|), so q.v <= (|q|^2 + M^2 - g^2) / 2
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.common import lowest_hash, materialise

PIVOTS = 64
SAMPLE = 4096  # rows the pivots are fitted on
MAX_SLABS = 2048
MIN_SLAB_ROWS = 2048
ANNULUS_ROWS = 512
QUERY_BLOCK = 1024
SLAB_SCHEMA = "slab bigint, rmin double, rmax double, norm double, pivot int, n int, ids binary, radii binary, mat binary"
RESULT = "query_id bigint, vec_id bigint, score bigint"


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, v`` with v = floor(scale * x); vectors that are NULL or hold NULL or non-finite parts go."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("v"))
            .filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).filter(~bad)
            .select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("bigint")).alias("v")))


def fit_pivots(v: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first pivots, moved to the means of their cells by a few Lloyd steps."""
    chosen, dist = [0], np.linalg.norm(v - v[0], axis=1)
    while len(chosen) < min(k, len(v)) and dist.max() > 0:
        chosen.append(int(dist.argmax()))
        dist = np.minimum(dist, np.linalg.norm(v - v[chosen[-1]], axis=1))
    pivots = v[chosen].astype(np.float64)
    for _ in range(4):
        near = nearest(v, pivots)[0]
        pivots = np.array([v[near == j].mean(axis=0) if (near == j).any() else pivots[j] for j in range(len(pivots))])
    return pivots


def nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)
    near = square.argmin(axis=1)
    return near, np.linalg.norm(v - pivots[near], axis=1)


def _dense(col: pa.Array, dim: int) -> np.ndarray:
    """List column -> int64 matrix; shorter vectors are filled up with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy()
    out = np.zeros((len(col), dim), dtype=np.int64)
    out[np.repeat(np.arange(len(col)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _keyed(pivots: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _dense(b.column("v"), dim)
            near, dist = nearest(m.astype(np.float64), pivots)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(dist), pa.array([x.tobytes() for x in m], pa.binary())],
                ["vec_id", "pivot", "dist", "vec"])

    return run


def _packed(rows_per_slab: int, cut_at_pivot: bool):
    """Consecutive rows of a sorted partition -> slabs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # (ids, pivots, dists, matrix) of the slab being filled
        count = 0

        def flush():
            nonlocal held, count, seq
            ids, piv, dist, mat = (np.concatenate(x) for x in zip(*held, strict=True))
            norm = float(np.linalg.norm(mat.astype(np.float64), axis=1).max())
            row = [(part << 32) + seq, float(dist.min()), float(dist.max()), norm, int(piv[0]), len(ids),
                   ids.tobytes(), dist.tobytes(), mat.tobytes()]
            held, count, seq = [], 0, seq + 1
            types = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
            names = ["slab", "rmin", "rmax", "norm", "pivot", "n", "ids", "radii", "mat"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for b in batches:
            if not b.num_rows:
                continue
            ids, piv, dist = (b.column(c).to_numpy() for c in ("vec_id", "pivot", "dist"))
            mat = np.frombuffer(b"".join(b.column("vec").to_pylist()), dtype=np.int64).reshape(len(ids), -1)
            at = 0
            while at < len(ids):
                if held and (count >= rows_per_slab or cut_at_pivot and held[-1][1][-1] != piv[at]):
                    yield flush()
                stop = min(len(ids), at + rows_per_slab - count)
                if cut_at_pivot:
                    other = np.flatnonzero(piv[at:stop] != piv[at])
                    stop = at + int(other[0]) if len(other) else stop
                held.append((ids[at:stop], piv[at:stop], dist[at:stop], mat[at:stop]))
                count += stop - at
                at = stop
        if held:
            yield flush()

    return run


def bounds(q: np.ndarray, q_norm: np.ndarray, to_pivot: np.ndarray, dot_pivot: np.ndarray, r0, r1, norm) -> np.ndarray:
    """Upper bounds of q.v for every query (rows) and annulus (columns), with room for rounding."""
    gap = np.maximum(0, np.maximum(to_pivot - r1, r0 - to_pivot))
    first = dot_pivot + q_norm[:, None] * r1
    second = (q_norm[:, None] ** 2 + norm**2 - gap**2) / 2
    best = np.minimum(first, np.minimum(second, q_norm[:, None] * norm))
    return best + 1e-6 * (1 + np.abs(best) + q_norm[:, None] * norm + q_norm[:, None] ** 2)


def _query_side(q: np.ndarray, pivots: np.ndarray):
    qf = q.astype(np.float64)
    norm = np.sqrt((qf * qf).sum(1))
    dist = np.sqrt(np.maximum(0, norm[:, None] ** 2 - 2 * qf @ pivots.T + (pivots * pivots).sum(1)))
    return norm, dist, qf @ pivots.T


def _visits(meta: dict[str, np.ndarray], pivots: np.ndarray, first: bool):
    """Slabs that each query block has to expand; ``first``: the seeds, else all the rest that may still matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv = meta["pivot"]
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n")[i].as_py()
                q = np.frombuffer(b.column("mat")[i].as_py(), dtype=np.int64).reshape(n, -1)
                norm, dist, dot = _query_side(q, pivots)
                ub = bounds(q, norm, dist[:, piv], dot[:, piv], meta["rmin"], meta["rmax"], meta["norm"])
                # seeds: the slab around the query's own key, and the slab that promises most
                own = np.where(piv == dist.argmin(1)[:, None], np.abs((meta["rmin"] + meta["rmax"]) / 2 - dist.min(1)[:, None]), np.inf)
                seed = np.zeros(ub.shape, dtype=bool)
                seed[np.arange(n), own.argmin(1)] = True
                seed[np.arange(n), ub.argmax(1)] = True
                seeds = seed.any(0)
                if first:
                    go, low = seeds, np.full(n, -np.inf)
                else:
                    low = np.frombuffer(b.column("low")[i].as_py(), dtype=np.float64)
                    go = (ub >= low[:, None]).any(0) & ~seeds
                hit = meta["slab"][go]
                block = b.column("block")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hit, pa.int64()), pa.array([block] * len(hit), pa.int64()),
                     pa.array([low.tobytes()] * len(hit), pa.binary())], ["slab", "block", "low"])

    return run


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _expand(pivots: np.ndarray, k: int):
    """Search one slab for one query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i].as_py()  # noqa: B023, E731
                n, m = get("n"), get("qn")
                ids, radii = np.frombuffer(get("ids"), dtype=np.int64), np.frombuffer(get("radii"), dtype=np.float64)
                v = np.frombuffer(get("mat"), dtype=np.int64).reshape(n, -1)
                qid, q = np.frombuffer(get("qids"), dtype=np.int64), np.frombuffer(get("qmat"), dtype=np.int64).reshape(m, -1)
                low = np.frombuffer(get("low"), dtype=np.float64).copy()
                norm, dist, dot = _query_side(q, pivots[get("pivot")][None, :])
                cuts = np.arange(0, n, ANNULUS_ROWS)
                last = np.minimum(cuts + ANNULUS_ROWS, n) - 1
                v_norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
                far = np.array([v_norm[a:z + 1].max() for a, z in zip(cuts, last, strict=True)])
                ub = bounds(q, norm, dist, dot, radii[cuts], radii[last], far)
                peak = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1])
                kind = np.float64 if peak < 2**53 else np.int64  # sums of integers below 2^53 are exact in doubles
                best_ids = [np.empty(0, dtype=np.int64)] * m
                best = [np.empty(0, dtype=np.int64)] * m
                for a in np.argsort(-ub.max(0), kind="stable"):
                    go = np.flatnonzero(ub[:, a] >= low)
                    if not len(go):
                        continue
                    part = slice(cuts[a], last[a] + 1)
                    scores = (q[go].astype(kind) @ v[part].T.astype(kind)).astype(np.int64)
                    for row, j in enumerate(go):
                        keep = np.flatnonzero((scores[row] >= low[j]) & (ids[part] != qid[j]))
                        if not len(keep):
                            continue
                        all_ids = np.concatenate([best_ids[j], ids[part][keep]])
                        all_scores = np.concatenate([best[j], scores[row][keep]])
                        top = _top(all_ids, all_scores, k)
                        best_ids[j], best[j] = all_ids[top], all_scores[top]
                        if len(top) == k:
                            low[j] = max(low[j], float(best[j][-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qid, [len(x) for x in best])), pa.array(np.concatenate(best_ids)), pa.array(np.concatenate(best))],
                    ["query_id", "vec_id", "score"])

    return run


def topk(vectors: DataFrame, query_filter, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
         scale: int = 1024, pivots: int = PIVOTS, min_slab_rows: int = MIN_SLAB_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best inner products of each query among all other rows.

    ``query_filter`` is a condition on ``vec_id`` that names the queries.
    Components are floor(scale * x).  Vectors that are NULL or hold a NULL or
    non-finite component, and rows without an id, take no part; a shorter vector counts as filled up
    with zeros.  Ties go to the smaller id; a query's own id is no candidate;
    with fewer than k candidates all are returned; no vectors or no queries
    give an empty result.  Columns other than the id and the vector are ignored.
    Pivots are fitted on at most ``SAMPLE`` rows; every row is indexed and the
    result is exact.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vec_col, scale)
    total, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not total:
        return empty
    dim = max(1, dim)
    sample = lowest_hash(rows, SAMPLE, "vec_id").toArrow()
    centres = fit_pivots(_dense(sample.column("v"), dim).astype(np.float64), pivots)

    keyed = rows.mapInArrow(_keyed(centres, dim), "vec_id bigint, pivot int, dist double, vec binary")
    order = ["pivot", "dist", "vec_id"]
    per_slab = max(min_slab_rows, -(-total // MAX_SLABS))
    slabs = materialise(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                        .mapInArrow(_packed(per_slab, True), SLAB_SCHEMA), "slabs")
    blocks = materialise(keyed.filter(query_filter).repartitionByRange(*order).sortWithinPartitions(*order)
                         .mapInArrow(_packed(QUERY_BLOCK, False), SLAB_SCHEMA)
                         .select(F.col("slab").alias("block"), "n", "ids", "mat"), "query-blocks")
    # bounded: at most MAX_SLABS + pivots + partitions rows of five numbers
    head = slabs.select("slab", "pivot", "rmin", "rmax", "norm").orderBy("slab").toPandas()
    meta = {c: head[c].to_numpy() for c in head}

    def search(block_rows: DataFrame, first: bool) -> DataFrame:
        visits = block_rows.mapInArrow(_visits(meta, centres, first), "slab bigint, block bigint, low binary")
        q = blocks.select("block", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("mat").alias("qmat"))
        pairs = visits.join(q, "block").join(slabs.select("slab", "pivot", "n", "ids", "radii", "mat"), "slab")
        return pairs.mapInArrow(_expand(centres, k), RESULT)

    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)
    seeds = materialise(best(search(blocks, True)).select("query_id", "vec_id", "score", "rank"), "seeds")
    # the k-th score so far of every query, put beside its block (QUERY_BLOCK entries at most)
    kth = seeds.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("low"))
    place = blocks.select("block", "ids").mapInArrow(_places, "block bigint, pos int, query_id bigint")
    lows = (place.join(kth, "query_id", "left").groupBy("block")
            .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("low", F.lit(float("-inf"))).alias("low")))).alias("lows")))
    rest = search(blocks.join(lows, "block").mapInArrow(_with_lows, "block bigint, n int, mat binary, low binary"), False)
    return best(seeds.select("query_id", "vec_id", "score").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, ids in zip(b.column("block").to_pylist(), b.column("ids").to_pylist(), strict=True):
            q = np.frombuffer(ids, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(q), pa.int64()), pa.array(np.arange(len(q), dtype=np.int32)), pa.array(q)],
                                             ["block", "pos", "query_id"])


def _with_lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        low = [np.array([x["low"] for x in row]).tobytes() for row in b.column("lows").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("n"), b.column("mat"), pa.array(low, pa.binary())], ["block", "n", "mat", "low"])
