"""Modeling building blocks: preprocessing semantics, forest export, scoring rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from docket import config as C
from docket.operators import forest as FO
from docket.operators import modeling as ML


def _frame(spark, rows):
    cols = ", ".join(f"{c} string" for c in C.CATEGORICAL_FEATURES) + ", " + ", ".join(
        f"{c} double" for c in C.NUMERIC_FEATURES)
    return spark.createDataFrame(rows, f"external_id string, label double, {cols}")


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        src = ["a", "b", "c", None][i % 4]
        sla = None if i % 10 == 0 else float(rng.integers(1, 100))
        y = float((sla or 50) > 60 or src == "c")
        rows.append((str(i), y, src, "s", "r", "t", "n", float(i % 12 + 1), float(i % 7), float(i % 24),
                     float(i % 7 >= 5), sla))
    return _frame(spark, rows)


def test_prep_unseen_category_is_all_zero_and_median_exact(spark, train):
    prep = ML.fit_prep(train)
    sla = [r[0] for r in train.select("sla_duration_hours").collect() if r[0] is not None]
    assert prep.medians["sla_duration_hours"] == pytest.approx(float(np.median(sla)))
    new = _frame(spark, [("x", 0.0, "zzz", "s", "r", "t", "n", 1.0, 0.0, 0.0, 0.0, None)])
    v = prep.transform(new).select(vector_to_array("features").alias("v")).first()["v"]
    n_source = len(prep.encoder.stages[0].labels)
    assert v[:n_source] == [0.0] * n_source  # unseen source -> all zeros
    # missing SLA imputed with the median, then standardised
    want = (prep.medians["sla_duration_hours"] - prep.means["sla_duration_hours"]) / prep.scales["sla_duration_hours"]
    assert v[-1] == pytest.approx(want)


def test_forest_export_matches_model_probability(spark, train):
    fc = ML.fit_classifier(train, "rf", {"n_estimators": 5, "max_depth": 5, "min_samples_leaf": 2})
    feats = fc.prep.transform(train)
    spread = {r["external_id"]: r for r in FO.forest_spread(feats, fc.model, "external_id").collect()}
    prob = fc.model.transform(feats).select("external_id", ML.prob1().alias("p")).collect()
    for r in prob:
        assert spread[r["external_id"]]["tree_mean"] == pytest.approx(r["p"], abs=1e-9)


def test_score_cases_rules(spark, train):
    clf = ML.fit_classifier(train, "logreg")
    reg = ML.fit_regressor(train.withColumn("label", F.col("open_hour") * 3.0), "enet", log1p=True)
    s = ML.score_cases(train.drop("label"), clf, reg).collect()
    for r in s:
        if r["sla_duration_hours"] is None:
            assert r["delay_probability"] is None and r["predicted_is_delayed"] is None and r["risk_level"] is None
        else:
            assert 0 <= r["risk_score"] <= 100
        assert r["predicted_hours"] >= 0 and r["ok"] == 1


def test_tree_shap_local_accuracy(spark, train):
    from docket.operators import shap as SH

    fc = ML.fit_classifier(train, "rf", {"n_estimators": 4, "max_depth": 4, "min_samples_leaf": 2})
    feats = fc.prep.transform(train.limit(40))
    contrib = SH.forest_shap(feats, fc.model, "external_id", fc.prep.feature_names())
    sums = {r["external_id"]: (r["s"], r["b"]) for r in contrib.groupBy("external_id").agg(
        F.sum("contribution").alias("s"), F.first("base_value").alias("b")).collect()}
    prob = fc.model.transform(feats).select("external_id", ML.prob1().alias("p")).collect()
    for r in prob:
        s, b = sums[r["external_id"]]
        assert s + b == pytest.approx(r["p"], abs=1e-9)
