"""Single rules: white space, overrides, thresholds, deadlines, scoring features, fingerprints, training parameters."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket import config as C
from docket.functions import exprs as X
from docket.operators import dataset as D
from docket.operators import ingest as I
from docket.operators import interact as IA
from docket.operators import metrics as M
from docket.operators import modeling as ML
from docket.operators import ordering as O
from docket.operators import quality as Q


def test_strip_takes_all_white_space(spark):
    texts = ["\t", "  a b \n", "\x1f", "", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["s"] for r in df.select("i", X.blank_to_null("t").alias("s")).orderBy("i").collect()]
    assert got == [t.strip() or None for t in texts]


def test_scoring_features_keep_old_versions_and_absent_keys(spark):
    base = {"created_at": "2024-01-06T10:00:00", "deadline": "2024-01-05T10:00:00", "external_id": "1", "source": "a", "subject": "b",
            "reason": None, "type": "d"}
    rows = [("1", "opening", "opening-v0", json.dumps(base)), ("2", "opening", C.FEATURE_SCHEMA_VERSION, "{bad"),
            ("3", "closing", C.FEATURE_SCHEMA_VERSION, json.dumps(base)), ("4", "opening", C.FEATURE_SCHEMA_VERSION, json.dumps({"deadline": None}))]
    df = spark.createDataFrame(rows, "external_id string, snapshot_type string, feature_schema_version string, input_json string")
    got = {r["external_id"]: r for r in D.scoring_features(df).collect()}
    assert set(got) == {"1", "2", "4"}
    assert (got["1"]["neighborhood"], got["1"]["reason"], got["1"]["has_sla"], got["1"]["sla_duration_hours"]) == ("missing", None, 1, None)
    assert got["2"]["feature_error"] == "malformed input_json" and got["4"]["feature_error"].startswith("created_at")


def test_live_case_without_score_is_counted(spark):
    t = dt.datetime(2024, 1, 1)
    procs = spark.createDataFrame([("1", t, t), ("2", t, t)], "external_id string, completed_at timestamp_ntz, deadline timestamp_ntz")
    feats = spark.createDataFrame([("1", None), ("2", None)], "external_id string, feature_error string")
    scores = spark.createDataFrame([("1", 0.9)], "external_id string, p double")
    r = IA.live_evaluation(IA.live_cases(procs, feats, scores)).first()
    assert (r["total_evaluated"], r["prediction_failures"], r["skipped_no_snapshot"]) == (1, 1, 0)


def test_threshold_without_positive_f1_is_one_half(spark):
    df = spark.createDataFrame([("v", 0, 0.2), ("v", 0, 0.9), ("w", 1, 0.3), ("w", 0, 0.1)], "split string, y int, p double")
    best = {r["split"]: r["cut"] for r in M.threshold_table(df).where("is_best = 1").collect()}
    assert best["v"] == pytest.approx(0.5) and best["w"] == pytest.approx(0.15)


def test_override_code_is_not_trimmed(spark):
    cols = ", ".join(f"{c} string" for c in C.CATEGORICAL_FEATURES) + ", open_month int, open_weekday int, open_hour int, is_weekend int, sla_duration_hours double"
    rows = [(1, " asia "), (2, "asia"), (3, None)]
    df = spark.createDataFrame([(i, 1, i, v, *[None] * 9) for i, v in rows], f"scenario_id int, base_prediction_id int, process_id int, {cols}")
    opts = spark.createDataFrame([("source", "asia")], "column string, code string")
    got = {r["scenario_id"]: r["reject_code"] for r in IA.override_rules(df, opts).collect()}
    assert got == {1: "OVERRIDE_NOT_ALLOWED", 2: None, 3: "NO_OVERRIDE"}


def test_stored_deadline_survives_a_missing_fingerprint(spark):
    from docket.plans.views import STATE_SCHEMA

    t = dt.datetime(2024, 1, 1)
    state = spark.createDataFrame([("1", t, t, None, None, None, "x", None, None, C.CANONICAL_MAPPING_VERSION, "f")], STATE_SCHEMA)
    none = spark.createDataFrame([], "external_id string, _file_seq int, _row long, decision string, completed_at timestamp_ntz, current_status string, "
                                 "closure_reason string, row_fp string, _file string, created_at timestamp_ntz, deadline timestamp_ntz, type_code string, opening_fp string")
    assert I.apply_outcomes(state, none).first()["deadline"] == t


def test_hot_key_in_a_delivery(spark):
    """One id holds a third of the rows: decisions follow the file order."""
    from tests.test_ingest import BASE, catalog

    rows = []
    for i in range(300):
        r = dict(BASE, case_enquiry_id="hot" if i % 3 == 0 else str(i), case_status=f"s{i // 6 % 2}")
        rows.append((*r.values(), "a.csv", 1, i + 1))
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in BASE) + ", _file string, _file_seq int, _row long").repartition(7)
    from docket.plans.views import STATE_SCHEMA

    out = I.run_import(df, spark.createDataFrame([], STATE_SCHEMA), catalog(spark))
    got = {r["_row"]: r["decision"] for r in out["rows"].where("external_id = 'hot'").collect()}
    want, last = {}, None
    for i in range(0, 300, 3):
        status = f"s{i // 6 % 2}"
        want[i + 1] = "insert" if last is None else "skip" if status == last else "update"
        last = status
    assert got == want


def test_fingerprint_tells_null_from_shift(spark):
    cols = ["external_id", *C.ALL_FEATURES, "is_delayed"]
    kinds = {"external_id": "string", **{c: "string" for c in C.CATEGORICAL_FEATURES}, **{c: "int" for c in C.NUMERIC_FEATURES}, "sla_duration_hours": "double", "is_delayed": "int"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", split string, schema_error string"

    def fp(source, subject):
        df = spark.createDataFrame([("1", source, subject, "r", "t", "n", 1, 2, 3, 0, 4.5, 1, "train", None)], schema)
        return D.dataset_fingerprint(df, "is_delayed", C.TEST_CUTOFF).first()["fingerprint"]

    assert len({fp(None, "a"), fp("a", None), fp("a", "a"), fp("", "a")}) == 4


def test_quantiles_and_ranks_with_one_large_group(spark):
    rng = np.random.default_rng(2)
    rows = [("big" if i % 10 else "small", float(rng.integers(0, 40))) for i in range(2000)] + [(None, 1.0), ("big", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["a"], r["b"]) for r in O.exact_quantiles(df, ["g"], "x", {"a": 0.5, "b": 0.9}).collect()}
    for g in ("big", "small", None):
        v = [x for h, x in rows if h == g and x is not None]
        assert got[g] == pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.9)))
    ranks = O.group_rank(df.where("x IS NOT NULL"), ["g"], ["x"]).groupBy("g").agg(F.max("_rank").alias("m"), F.countDistinct("_rank").alias("n"), F.count("*").alias("c")).collect()
    assert all(r["m"] + 1 == r["n"] == r["c"] for r in ranks)


def test_run_and_issue_domains(spark):
    runs = spark.createDataFrame([("completed", *[0] * 8), ("paused", -1, *[0] * 7)],
                                 "status string, total_rows long, imported_rows long, inserted_rows long, updated_rows long, skipped_duplicate_rows long, "
                                 "quarantined_rows long, error_rows long, warning_count long")
    got = {r["rule"]: r["violations"] for r in Q.domain_violations(runs, Q.run_rules()).collect()}
    assert got["status_domain"] == 1 and got["total_rows_not_negative"] == 1 and sum(got.values()) == 2


@pytest.fixture(scope="module")
def numbers(spark):
    """Two numeric signals in the feature layout, label from a logistic model."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        sla, hour = float(rng.integers(1, 100)), float(rng.integers(0, 24))
        p = 1 / (1 + np.exp(-(0.05 * (sla - 50) + 0.1 * (hour - 12))))
        rows.append((f"{i:04d}", float(rng.random() < p), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "train" if i < 450 else "validation",
                     "s" if i % 3 else None, "b", "r", "t", "n", 1.0, 2.0, hour, 0.0, sla))
    cols = "external_id string, label double, created_at timestamp_ntz, split string, " + ", ".join(f"{c} string" for c in C.CATEGORICAL_FEATURES) + ", " + ", ".join(
        f"{c} double" for c in C.NUMERIC_FEATURES)
    return spark.createDataFrame(rows, cols)


def _matrix(prep, df):
    from pyspark.ml.functions import vector_to_array

    rows = prep.transform(df).select("label", vector_to_array("features").alias("v")).collect()
    return np.array([r["v"] for r in rows]), np.array([r["label"] for r in rows])


def test_logistic_regression_equals_newton(spark, numbers):
    fc = ML.fit_classifier(numbers, "logreg", {"C": 0.5})
    x, y = _matrix(fc.prep, numbers)
    x1 = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x1.shape[1]), np.append(np.full(x.shape[1], 1 / 0.5), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        h = x1.T @ (x1 * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-12)
        w = w - np.linalg.solve(h, x1.T @ (p - y) + ridge * w)
    assert np.allclose(fc.model.coefficients.toArray(), w[:-1], atol=1e-4) and abs(fc.model.intercept - w[-1]) < 1e-4


def test_elastic_net_equals_coordinate_descent(spark, numbers):
    df = numbers.withColumn("label", F.col("sla_duration_hours") * 0.3 + F.col("open_hour") + F.col("label"))
    fr = ML.fit_regressor(df, "enet", {"alpha": 0.5, "l1_ratio": 0.5})
    x, y = _matrix(fr.prep, df)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w, a, r = np.zeros(x.shape[1]), 0.5, 0.5
    for _ in range(2000):
        for j in range(len(w)):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - a * r, 0) / (xc[:, j] @ xc[:, j] / len(y) + a * (1 - r)) if xc[:, j].any() else 0.0
    assert np.allclose(fr.model.coefficients.toArray(), w, atol=2e-3)


def test_isotonic_equals_pool_adjacent_violators(spark):
    rng = np.random.default_rng(6)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(float)
    oof = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "p_raw double, label double")
    _, iso = ML.fit_calibrators(oof)
    blocks = []
    for s in np.unique(p):
        blocks.append([y[p == s].sum(), (p == s).sum(), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    want = {s: b[0] / b[1] for b in blocks for s in b[2]}
    got = {r["p_raw"]: r["p"] for r in ML.apply_calibration(oof, "p_raw", "isotonic", None, iso).collect()}
    assert all(got[s] == pytest.approx(v, abs=1e-9) for s, v in want.items())
    with pytest.raises(ValueError):
        ML.apply_calibration(oof, "p_raw", "sigmoid", None, iso)


def test_training_parameters_are_kept(spark):
    rf = ML.regressor("rf", params={"max_depth": None, "max_features": 0.5, "min_samples_leaf": 7})
    assert (rf.getMaxDepth(), rf.getFeatureSubsetStrategy(), rf.getMinInstancesPerNode()) == (30, "0.5", 7)
    assert ML.regressor("rf").getFeatureSubsetStrategy() == "all"
    gb = ML.classifier("gbt", 10, {"max_depth": None, "min_samples_leaf": 50})
    assert gb.getMinInstancesPerNode() == 50 and gb.getMaxDepth() == ML.BOOSTING_DEPTH
    assert ML.classifier("logreg", 10).getMaxIter() == 2000 and ML.regressor("enet", 1.0).getMaxIter() == 5000
    with pytest.raises(ValueError):
        ML.classifier("rf", 10, {"max_depth": 40})


def test_class_weights_are_balanced(spark, numbers):
    w = ML.class_weights(numbers)
    n = {k: numbers.where(F.col("label") == k).count() for k in (0.0, 1.0)}
    assert all(w[k] == pytest.approx(600 / (2 * n[k])) for k in n)


def test_regressor_folds_and_search(spark, numbers):
    df = numbers.withColumn("label", F.col("sla_duration_hours") * 2)
    folded = M.time_folds(df.where("split = 'train'"), 3)
    cv = ML.regression_fold_metrics(ML.oof_hours(folded, "enet", {"alpha": 0.01, "l1_ratio": 0.0}, 3)).first()
    assert 0 < cv["cv_mae_mean"] < 20 and cv["cv_rmse_mean"] >= cv["cv_mae_mean"]
    best, table = ML.search_regressor(folded, "enet", {"alpha": [0.01, 50.0], "l1_ratio": [0.0]}, 2, 3)
    assert best["alpha"] == 0.01 and table.count() == 2
    _, table = ML.search(M.time_folds(numbers.where("split = 'train'"), 3), "rf", {"max_depth": [0], "n_estimators": [3]}, 1, 3)
    assert "max_depth" in table.first()["error"]


def test_similar_cases(spark, numbers):
    from docket.operators import similar as SM

    train = numbers.where("split = 'train'").withColumns({"is_delayed": F.col("label").cast("int"), "total_duration_hours": F.lit(1.5)})
    queries = numbers.where("split = 'validation'").limit(5)
    prep = ML.fit_prep(train)
    procs = numbers.select("external_id", F.lit("kind").alias("process_type"))
    rows = SM.similar_cases(prep, queries, train, procs, 5).collect()
    assert len(rows) == 25 and {r["process_type"] for r in rows} == {"kind"}
    from pyspark.ml.functions import vector_to_array

    vec = lambda d: {r["external_id"]: np.array(r["v"]) for r in prep.transform(d).select("external_id", vector_to_array("features").alias("v")).collect()}
    tv, qv = vec(train), vec(queries)
    for q, v in qv.items():
        want = sorted((round(float(np.linalg.norm(v - u)), 9), t) for t, u in tv.items())[:5]
        assert [r["neighbor_external_id"] for r in sorted((r for r in rows if r["external_id"] == q), key=lambda r: r["rank"])] == [t for _, t in want]
