"""Metrics, quantiles, ordering helpers and KNN against NumPy brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.operators import metrics as M
from docket.operators import ordering as O
from docket.operators import similar as SM


def _auc_np(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def _ap_np(y, p):
    ap, P = 0.0, y.sum()
    for t in np.unique(p)[::-1]:
        sel = p >= t
        tp = (y[sel] == 1).sum()
        ap += ((y[p == t] == 1).sum() / P) * tp / sel.sum()
    return ap


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    n = 3000
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(0.3 * y + 0.7 * rng.random(n), 0, 1), 2)  # ties on purpose
    g = np.where(rng.random(n) < 0.5, "train", "validation")
    df = spark.createDataFrame([(str(a), int(b), float(c)) for a, b, c in zip(g, y, p)], "split string, y int, p double")
    return df, y, p, g


def test_auc_ap_confusion_match_bruteforce(spark, scored):
    df, y, p, g = scored
    out = {r["split"]: r for r in M.classification_metrics(df, threshold=0.35).collect()}
    for s in ("train", "validation"):
        m = g == s
        assert out[s]["roc_auc"] == pytest.approx(_auc_np(y[m], p[m]), abs=1e-12)
        assert out[s]["pr_auc"] == pytest.approx(_ap_np(y[m], p[m]), abs=1e-12)
        pred = (p[m] >= 0.35).astype(int)
        tp = int(((pred == 1) & (y[m] == 1)).sum())
        assert out[s]["tp"] == tp
        assert out[s]["brier"] == pytest.approx(np.mean((p[m] - y[m]) ** 2))


def test_seal_guard(spark, scored):
    df, *_ = scored
    sealed = df.withColumn("split", F.lit("test"))
    r = M.classification_metrics(sealed).first()
    assert r["row_count"] == 3000 and r["roc_auc"] is None and r["f1"] is None
    with pytest.raises(PermissionError):
        M.assert_evaluable("test")
    with pytest.raises(ValueError):
        M.assert_evaluable("holdout")
    M.assert_evaluable("audit", allow_sealed=True)


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([("v", 1, 0.2), ("v", 1, 0.9)], "split string, y int, p double")
    r = M.classification_metrics(df, allow_sealed=True).first()
    assert r["roc_auc"] is None


def test_exact_quantiles_and_global_index(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=5001)
    vals[:1700] = 0.25  # a third of all rows share one value
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(vals)], "x double, g int")
    q = {r["g"]: r for r in O.exact_quantiles(df, ["g"], "x", {"q1": 0.25, "med": 0.5, "p90": 0.9}).collect()}
    for gi in range(3):
        sub = vals[np.arange(len(vals)) % 3 == gi]
        assert q[gi]["med"] == pytest.approx(np.percentile(sub, 50), abs=1e-12)
        assert q[gi]["p90"] == pytest.approx(np.percentile(sub, 90), abs=1e-12)
    idx = O.global_index(df.withColumn("k", F.monotonically_increasing_id()), ["x", "k"], "i")
    got = idx.orderBy("i").select("i", "x").collect()
    assert [r["i"] for r in got] == list(range(len(vals)))
    assert np.allclose([r["x"] for r in got], np.sort(vals))


def test_regression_metrics(spark):
    rng = np.random.default_rng(5)
    y, yhat = rng.exponential(100, 2000), rng.exponential(100, 2000)
    df = spark.createDataFrame([("validation", float(a), float(b)) for a, b in zip(y, yhat)],
                               "split string, y double, yhat double")
    r = M.regression_metrics(df).first()
    ae = np.abs(y - yhat)
    assert r["mae"] == pytest.approx(ae.mean())
    assert r["median_ae"] == pytest.approx(np.median(ae))
    assert r["p90_abs_error"] == pytest.approx(np.percentile(ae, 90))
    assert r["rmse"] == pytest.approx(np.sqrt(np.mean((y - yhat) ** 2)))


def test_threshold_search_first_cut_wins_ties(spark):
    df = spark.createDataFrame([("v", 1, 0.95), ("v", 0, 0.05)], "split string, y int, p double")
    t = M.threshold_table(df).where("is_best = 1").first()
    assert t["f1"] == 1.0 and t["cut"] == pytest.approx(0.10)


def test_time_folds_expanding(spark):
    import datetime as dt

    rows = [(f"e{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "external_id string, created_at timestamp_ntz")
    f = {r["external_id"]: r for r in M.time_folds(df, 5).collect()}
    # 60 rows, K=5: test size 10, first 10 rows train only
    assert f["e000"]["test_fold"] is None and f["e010"]["test_fold"] == 0 and f["e059"]["test_fold"] == 4
    mem = M.fold_membership(M.time_folds(df, 5), 5)
    tr = mem.where("fold = 2 AND role = 'train'").count()
    assert tr == 30


def test_knn_exact_vs_bruteforce(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 8)).astype(np.float32)
    X[50] = X[51]  # an exact duplicate (tie)
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(300)], "id long, v array<float>")
    got = SM.knn(df, df, 5, "id", "id", "v", rows_per_block=64)
    res = {}
    for r in got.collect():
        res.setdefault(r["id"], []).append((r["rank"], r["neighbor_id"]))
    Xd = X.astype(np.float64)
    for i in range(300):
        d = np.sqrt(((Xd - Xd[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = sorted(range(300), key=lambda j: (d[j], j))[:5]
        assert [n for _, n in sorted(res[i])] == want


def test_knn_text_ids_and_ties(spark):
    from docket.operators import similar as SM

    rows = [(f"c{i}", [float(i % 3), 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "external_id string, v array<double>").repartition(3)
    got = {}
    for r in SM.knn(df, df, 3, "external_id", "external_id", "v", rows_per_block=4).collect():
        got.setdefault(r["external_id"], {})[r["rank"]] = r["neighbor_external_id"]
    for i, v in rows:
        want = sorted((abs(v[0] - w[0]), j) for j, w in rows if j != i)[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [j for _, j in want]
