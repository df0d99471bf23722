import numpy as np
import pytest

from docket.llm.whitening import jacobi_davidson, minres, whiten


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id bigint, embedding array<double>, x int").repartition(3)
    return whiten(df, **kw).collect()


def held(rows):
    kept = [(i, [int(np.floor(1024 * c)) + 100000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    return [i for i, _ in kept], np.array([x for _, x in kept], dtype=object)


def compare(out, rows, k):
    ids, x = held(rows)
    n, s = len(x), x.sum(axis=0)
    y = (x - np.array([t // n for t in s], dtype=object)).astype(float) - np.array([(t % n) / n for t in s])
    cov = y.T @ y / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    white = y @ axes / np.sqrt(e)
    dev = [int(((n * r - s) ** 2).sum()) for r in x]
    assert len(out) == n * k
    got = {(r["vec_id"], r["component"]): r for r in out}
    for j in range(k):
        mine = np.array([got[i, j + 1]["whitened"] for i in ids])
        assert min(np.abs(mine - white[:, j]).max(), np.abs(mine + white[:, j]).max()) < 1e-8
    for i, v in zip(ids, dev):
        r = got[i, 1]
        assert (int(r["deviation"]), r["n"]) == (v, n)
    assert all(abs(got[ids[0], j + 1]["explained"] - e[j] / np.trace(cov)) < 1e-10 for j in range(k))
    assert max(r["identity_error"] for r in out) < 1e-9
    assert max(r["residual"] for r in out) <= 1e-12 * e[0]


def test_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64)) * 0.3
    rows = [(i, (centres[i % 12] + rng.normal(size=64) * 0.1).tolist()) for i in range(400)]
    bad = [(900, None), (901, [None] * 64), (902, [float("nan")] * 64), (903, [float("inf")] + [0.0] * 63)]
    compare(run(spark, rows + bad), rows, 8)
    short = run(spark, rows + [(950, [1.0, 2.0]), (951, [])])  # another length takes no part
    assert len(short) == 400 * 8


def test_repeated_few_dimensions_and_large(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for i in range(60)]
    compare(run(spark, rows), rows, 5)
    twice = run(spark, rows + rows[:1] + [(None, rows[1][1])])
    assert len(twice) == 62 * 5 and {r["n"] for r in twice} == {62}
    large = [(i, [float(2**36) * c for c in v]) for i, v in rows]
    compare(run(spark, large, components=3), large, 3)


def test_no_variance_and_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []
    flat = run(spark, [(i, [0.5, 0.25]) for i in range(4)])
    assert len(flat) == 8 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)
    line = run(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])  # one direction only
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: (r["vec_id"], r["component"]))[:3]] == [False, True, True]
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0])], components=0)


@pytest.mark.parametrize("kind", ["clustered", "gap", "flat"])
def test_iteration(kind):
    rng = np.random.default_rng(3)
    d = 300
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = {"clustered": np.concatenate([[5, 5, 5, 4.999, 4.99], np.linspace(4, 0.1, d - 5)]),
         "gap": np.concatenate([np.linspace(100, 50, 10), rng.uniform(0, 1, d - 10)]), "flat": np.linspace(1.2, 1.0, d)}[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    calls = []

    def product(u):
        calls.append(u.shape[1])
        return a @ u

    values, x, residual = jacobi_davidson(product, d, 8)
    assert np.allclose(values, np.sort(e)[::-1][:8], atol=1e-11 * e.max()) and residual.max() <= 8 * d * 2.3e-16 * e.max()
    assert np.allclose(x.T @ x, np.eye(8), atol=1e-12)
    assert max(calls) < 64 < sum(calls)  # never the whole matrix at once


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    b = rng.normal(size=(30, 3))
    x = minres(lambda v: a @ v, b, 200, 1e-12)
    assert np.allclose(a @ x, b, atol=1e-6)
