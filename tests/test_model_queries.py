"""Registered model queries: the models that they fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from docket.operators import modeling as ML
from docket.plans import q_model as Q

from .conftest import SF_SMALL


def test_forest_queries_share_one_whole_forest(spark, monkeypatch):
    fits, fit = [], ML.tree_models

    def small(folded, kind, classes, candidates, n, **kw):
        fits.append((kind, candidates[0], kw))
        return fit(folded, kind, classes, [{**candidates[0], "n_estimators": 3, "max_depth": 3}], n, **kw)

    monkeypatch.setattr(ML, "tree_models", small)
    whole = dict(Q.FOREST)
    monkeypatch.setitem(Q.FOREST, "n_estimators", 7)  # a store of its own
    spread = Q.forest_spread(spark, SF_SMALL)
    n = spread.count()
    shap = Q.forest_shap(spark, SF_SMALL)
    assert shap.count() == 3 * n > 0
    assert fits == [("rf", {**whole, "n_estimators": 7}, {"balanced": True, "final": True})]
    assert whole == {"n_estimators": 300, "max_depth": None, "min_samples_leaf": 10, "max_features": "sqrt"}


def test_contributions_add_up_to_the_forest(spark, monkeypatch):
    from docket.operators import shap as SH
    from docket.operators import trees as T

    from .test_trees import data

    layout, codes, _, y = data(8, 90)
    fitted = T.fit_rows(layout, T.Spec(0, "rf", True, (("min_samples_leaf", 2), ("class_weight", "balanced"))), range(5), codes, y, np.arange(90))
    e = T.Ensemble(layout, fitted.spec, [fitted])
    rows = [(i, layout.levels[0][c[0]], layout.levels[1][c[1]], *(None if k == len(cu) else cu[k] for k, cu in zip(c[2:], layout.cuts))) for i, c in enumerate(codes.tolist())]
    df = spark.createDataFrame(rows, "id int, c0 string, c1 string, n0 double, n1 double")
    p = {r["id"]: r["p"] for r in e.transform(df, "p").collect()}
    for limit in (10**6, 30):
        monkeypatch.setattr(T, "SHARD_NODES", limit)
        got = SH.ensemble_shap(df, e, "id").groupBy("id").agg(F.sum("contribution").alias("s"), F.first("base_value").alias("b"), F.count("*").alias("n")).collect()
        assert len(got) == 90 and all(r["n"] == 4 and abs(r["s"] + r["b"] - p[r["id"]]) < 1e-9 for r in got)


def test_every_model_is_searched_and_the_forest_regressor_competes(spark, monkeypatch):
    from docket import config as C
    from docket.plans.registry import load

    seen = []

    def searched(name):
        def run(folded, kind, space, n, folds, flag=False):
            seen.append((name, kind, space, n, folds, flag))
            return {}, spark.createDataFrame([("{}", 1.0)], "params string, score double")
        return run

    monkeypatch.setattr(ML, "search", searched("classifier"))
    monkeypatch.setattr(ML, "search_regressor", searched("regressor"))
    queries = load()[0]
    for name in [n for n in queries if n.endswith("_search") and n != "threshold_search"]:
        assert queries[name](spark, SF_SMALL).first()["is_best"] == 1
    want = [("classifier", "logreg", False), ("classifier", "rf", False), ("classifier", "gbt", False),
            ("regressor", "enet", True), ("regressor", "rf", False), ("regressor", "gbt", False)]
    assert sorted(seen, key=str) == sorted([(n, k, C.SEARCH_SPACES["rf_regressor" if (n, k) == ("regressor", "rf") else k], 5, 5, f) for n, k, f in want], key=str)

    fits = []

    def trained(ds, kind, params, folds, log):
        fits.append((kind, params, folds, log))
        return None, spark.createDataFrame([("validation", 1.0 + len(fits))], "split string, mae double")

    monkeypatch.setattr(ML, "train_regressor", trained)
    assert Q.regression_training(spark, SF_SMALL).count() == 4
    assert ("rf", {**Q.FOREST, "max_features": 1.0}, 5, False) in fits


def test_search_is_refitted_and_validated(spark, monkeypatch):
    seen = {}

    def searched(folded, kind, space, n, folds):
        seen["search"] = (kind, space, n, folds, folded.filter("test_fold IS NOT NULL").count() > 0)
        return {"max_iter": 3}, None

    def trained(ds, kind, params, folds):
        seen["train"] = (kind, params, folds)
        return "fitted", spark.createDataFrame([("gbt", 0.5)], "model string, pr_auc double")

    monkeypatch.setattr(ML, "search", searched)
    monkeypatch.setattr(ML, "train_classifier", trained)
    fitted, best, metrics = ML.search_and_train(Q._dataset(spark, SF_SMALL), "gbt", {"max_iter": [3]}, 1, 2)
    assert (fitted, best, metrics.first()["params"]) == ("fitted", {"max_iter": 3}, "{'max_iter': 3}")
    assert seen == {"search": ("gbt", {"max_iter": [3]}, 1, 2, True), "train": ("gbt", {"max_iter": 3}, 2)}
