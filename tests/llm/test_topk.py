import numpy as np
from pyspark.sql import functions as F

from docket.llm.topk import bounds, topk


def brute(rows, k, step):
    ok = {i: np.floor(1024 * np.array(v, dtype=float)).astype(int) for i, v in rows
          if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dim = max((len(v) for v in ok.values()), default=0)
    ok = {i: np.pad(v, (0, dim - len(v))) for i, v in ok.items()}
    out = []
    for q in ok:
        if q % step == 0:
            best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, k=10, step=7, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")
    return sorted(map(tuple, topk(df, F.col("vec_id") % step == 0, k=k, **kw).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * 0.2).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2009, [1.0, 2.0]), (2016, [])]
    assert run(spark, rows, min_slab_rows=32, pivots=8) == brute(rows, 10, 7)


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0, 0.5]), (7, [0.5, 1.0]), (3, [-1.0, 0.25])]
    assert run(spark, rows) == brute(rows, 10, 7)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_bounds_hold():
    rng = np.random.default_rng(5)
    p, q, v = rng.normal(size=8) * 100, rng.normal(size=(20, 8)) * 100, rng.normal(size=(50, 8)) * 100
    r = np.linalg.norm(v - p, axis=1)
    norm = np.linalg.norm(q, axis=1)
    ub = bounds(q, norm, np.linalg.norm(q - p, axis=1)[:, None], (q @ p)[:, None], r, r, np.linalg.norm(v, axis=1))
    assert (ub >= q @ v.T).all()
