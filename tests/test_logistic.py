"""Logistic regressions fitted side by side against MLlib's, one at a time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docket import config as C
from docket.operators import metrics as M
from docket.operators import modeling as ML


def cases(spark, n=400, one_class=False):
    rnd, rows = random.Random(5), []
    for i in range(n):
        cats = [rnd.choice(["a", "b", None] if i > n // 2 else ["a", "b"]) for _ in C.CATEGORICAL_FEATURES]
        nums = [None if rnd.random() < 0.1 else float(rnd.randint(0, 9) * 10 ** j) for j in range(len(C.NUMERIC_FEATURES))]
        up = (cats[0] == "a") + (nums[0] or 4) / 9 + rnd.random() > 1.4
        rows.append((f"{i:04d}", i // 3, float(up and not (one_class and i < n // 2)), *cats, *nums))
    kinds = ", ".join([f"{c} string" for c in C.CATEGORICAL_FEATURES] + [f"{c} double" for c in C.NUMERIC_FEATURES])
    return M.time_folds(spark.createDataFrame(rows, f"external_id string, created_at int, label double, {kinds}").coalesce(1), 2).checkpoint()


@pytest.mark.parametrize("balanced", [False, True])
def test_folds_equal_single_fits(spark, balanced):
    folded = cases(spark)
    models = ML.logistic_models(folded, [{"C": 0.1}, {"C": 10.0}], 2, balanced, final=True)
    for c, k, strength in ((0, 1, 0.1),):
        train = folded.where(F.col("row_index") < F.col("first_test_index") + k * F.col("fold_test_size"))
        one = ML.fit_classifier(train, "logreg", {"C": strength}, balanced)
        want = {r["external_id"]: r["p_raw"] for r in one.raw_scores(folded).collect()}
        got = {r["external_id"]: r["p"] for r in models[c, k].transform(folded, "p").collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-5


def test_search_needs_no_fit_per_candidate(spark, monkeypatch):
    monkeypatch.setattr(ML, "fit_classifier", None)  # a job per candidate, fold and step
    best, table = ML.search(cases(spark), "logreg", {"C": [-1.0, 0.5, 5.0]}, 3, 2)
    rows = {r["params"]: r for r in table.collect()}
    assert best["C"] in (0.5, 5.0) and rows["{'C': -1.0}"]["error"] and all(rows[f"{{'C': {c}}}"]["cv_pr_auc_mean"] > 0.5 for c in (0.5, 5.0))


def test_one_class_is_certain(spark):
    folded = cases(spark, 90, one_class=True)
    p = [r["p"] for r in ML.logistic_models(folded, [{"C": 1.0}], 2)[0, 0].transform(folded, "p").select("p").distinct().collect()]
    assert p == [0.0]
