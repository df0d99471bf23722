import hashlib

import numpy as np

from docket.llm.centroids import cluster_vectors, nearest, sequency, walsh


def brute(rows, k=16, rounds=3, dim=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(64 * float(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [q for _, q in order[:k]]

    def assign(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in cents]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [assign(q)[0] for _, q in kept]
        cents = [[sum(col) // len(col) for col in zip(*[q for (_, q), a in zip(kept, at) if a == j])] if j in at else c for j, c in enumerate(cents)]
    out = [(i, *assign(q)) for i, q in kept]
    per = {j: sum(d for _, c, d in out if c == j) for j in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in out), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, q string").repartition(3)
    out = cluster_vectors(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted(((r[0], r[1], int(r[2]), int(r[3]), int(r[4]), r[5]) for r in out.collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 64))
    rows = [(i, (centres[i % 9] + rng.normal(size=64) * 0.4).tolist()) for i in range(300)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + rows[:5]  # ties and repeated rows
    rows += [(900, None), (901, [None] * 64), (902, [float("nan")] * 64), (903, [float("-inf")] + [0.0] * 63), (904, [1.0] * 63), (905, []), (None, rows[8][1])]
    assert run(spark, rows) == brute(rows)


def test_few_equal_large_and_empty(spark):
    assert run(spark, []) == []
    few = [(1, [0.5] * 64), (2, [-0.5] * 64), (3, [0.5] * 64)]
    assert run(spark, few) == brute(few)
    big = [(i, [float(2**40 * (i % 3)) + i] * 64) for i in range(30)]  # beyond a long when squared
    assert run(spark, big, k=4) == brute(big, k=4)
    assert run(spark, [(1, [1e300] * 64), *few]) == brute(few)


def test_other_dimension(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(90)]
    assert run(spark, rows, dim=5, k=7, rounds=2) == brute(rows, 7, 2, 5)


def test_transform_and_elimination():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, size=(40, 64))
    c = np.concatenate([x[:5], x[:5], rng.integers(-50, 50, size=(12, 64))])
    order = sequency(64)
    w = walsh(x, order)
    assert (w[:, 0] == x.sum(axis=1)).all()  # the coarsest coefficient
    assert ((w**2).sum(axis=1) == 64 * (x**2).sum(axis=1)).all()
    plain = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    cluster, total = nearest(w, walsh(c, order))
    assert (cluster == plain.argmin(axis=1)).all() and (total == 64 * plain.min(axis=1)).all()
