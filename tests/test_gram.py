"""Elastic net from Gram sums against a plain fit on the rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.operators import gram as G
from docket.operators import metrics as M
from docket.operators import modeling as ML


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(420):
        c, n1, n2 = str(rng.choice(["a", "b", "c", "d"])), float(rng.integers(0, 12)), float(np.round(rng.normal(50, 20), 2))
        y = 5.0 * (c == "a") + 2 * n1 - 0.3 * n2 + 40 + rng.normal()
        rows.append((f"k{i:04d}", i, None if i % 17 == 0 else c, n1, None if i % 11 == 0 else n2, float(max(y, 0))))
    df = spark.createDataFrame(rows, "external_id string, created_at bigint, source string, open_month double, sla_duration_hours double, label double").repartition(3)
    return df.withColumns({c: F.lit(None).cast("string") for c in ("subject", "reason", "type", "neighborhood")}).withColumns(
        {c: F.lit(1.0) for c in ("open_weekday", "open_hour", "is_weekend")})


def design(pdf, levels):
    x = [(pdf["source"].fillna("missing") == v).to_numpy(float) for v in levels]
    for c in ("open_month", "sla_duration_hours"):
        v = pdf[c].fillna(pdf[c].median()).to_numpy()
        x.append((v - v.mean()) / v.std())
    return np.stack(x, axis=1)


def objective(x, y, w, alpha, l1):
    e = y - y.mean() - (x - x.mean(axis=0)) @ w
    return e @ e / (2 * len(y)) + alpha * l1 * np.abs(w).sum() + alpha * (1 - l1) / 2 * w @ w


@pytest.mark.parametrize("log1p", [False, True])
def test_every_fold_is_the_optimum_of_its_rows(cases, log1p):
    folded = M.time_folds(cases, 3)
    grid = [{"alpha": 0.01, "l1_ratio": 0.0}, {"alpha": 0.5, "l1_ratio": 0.5}, {"alpha": 0.1, "l1_ratio": 1.0}]
    models = G.elastic_nets(folded, grid, 3, log1p)
    assert set(models) == {(c, k) for c in range(3) for k in range(4)}
    pdf = folded.toPandas()
    levels = G.fit_columns(folded).levels[0]
    at = pdf["first_test_index"][0], pdf["fold_test_size"][0]
    for (c, k), m in models.items():
        train = pdf if k == 3 else pdf[pdf["row_index"] < at[0] + k * at[1]]
        x, y = design(train, levels), np.log1p(train["label"].to_numpy()) if log1p else train["label"].to_numpy()
        sd = [train[n].fillna(train[n].median()).std(ddof=0) for n in ("open_month", "sla_duration_hours")]
        slopes = dict(zip(m.columns.numeric, m.slopes))
        w = np.append(m.weights[0], [slopes["open_month"] * sd[0], slopes["sla_duration_hours"] * sd[1]])
        best = objective(x, y, w, grid[c]["alpha"], grid[c]["l1_ratio"])
        rng = np.random.default_rng(0)
        for step in (1e-2, 1e-4):
            assert all(objective(x, y, w + step * rng.normal(size=len(w)), grid[c]["alpha"], grid[c]["l1_ratio"]) >= best - 1e-10 for _ in range(40))
        got = m.transform(folded, "p").select("external_id", "p").toPandas().set_index("external_id")["p"]
        want = y.mean() + (x - x.mean(axis=0)) @ w
        assert np.allclose(got[train["external_id"]].to_numpy(), np.expm1(want) if log1p else want, atol=1e-6)


def test_ridge_has_a_closed_form(cases):
    m = G.elastic_nets(M.time_folds(cases, 3), [{"alpha": 2.0, "l1_ratio": 0.0}], 3)[0, 3]
    pdf = cases.toPandas()
    x, y = design(pdf, m.columns.levels[0]), pdf["label"].to_numpy()
    x = x - x.mean(axis=0)
    want = np.linalg.solve(x.T @ x / len(y) + 2.0 * np.eye(x.shape[1]), x.T @ (y - y.mean()) / len(y))
    sd = [pdf[n].fillna(pdf[n].median()).std(ddof=0) for n in ("open_month", "sla_duration_hours")]
    slopes = dict(zip(m.columns.numeric, m.slopes))
    assert np.allclose(np.append(m.weights[0], [slopes["open_month"] * sd[0], slopes["sla_duration_hours"] * sd[1]]), want, atol=1e-7)


def test_search_and_odd_rows(spark, cases):
    best, table = ML.search_regressor(M.time_folds(cases, 3), "enet", {"alpha": [0.01, 50.0], "l1_ratio": [0.5]}, 2, 3, True)
    assert best["alpha"] == 0.01 and table.filter("error IS NOT NULL").count() == 0
    m = G.elastic_nets(M.time_folds(cases, 3), [{}], 3)[0, 3]
    odd = cases.limit(2).withColumns({"source": F.lit("never seen"), "sla_duration_hours": F.lit(float("nan")), "open_month": F.lit(None).cast("double")})
    assert all(np.isfinite(r["p"]) for r in m.transform(odd, "p").collect())
    with pytest.raises(ValueError):
        ML.hour_models(M.time_folds(cases, 3), "enet", [{"alpha": -1.0}], 3)
