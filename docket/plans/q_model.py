"""Registered queries: baselines, training flows, scoring, importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket import config as C
from docket.operators import dataset as D
from docket.operators import gram as G
from docket.operators import metrics as M
from docket.operators import modeling as ML
from docket.operators.ordering import exact_quantiles
from docket.plans import sql as S
from docket.plans import views as V
from docket.plans.registry import r, register


def _dataset(spark, sf_dir):
    return D.build_dataset(V.snapshot_view(spark, sf_dir), V.process_view(spark, sf_dir), C.TEST_SPLITS,
                           C.TEST_CUTOFF)


_COH = "dsx WHERE schema_error = 0 AND split IS NOT NULL"


@register("train_summary", S.with_ctes(f"""
SELECT {r("(SELECT avg(is_delayed) FROM " + _COH + " AND is_delayed IS NOT NULL AND split = 'train')")} AS delayed_rate,
       {r("(SELECT quantile_cont(total_duration_hours, 0.5) FROM " + _COH +
          " AND total_duration_hours IS NOT NULL AND split = 'train')")} AS median_duration_hours""", "dsx"))
def train_summary(spark, sf_dir):
    """Delayed rate of the classification train split and median hours of the regression train split."""
    # both cohorts read one stored pass over the cases
    ds = ML.materialize(_dataset(spark, sf_dir).select("split", "schema_error", "is_delayed", "total_duration_hours"))
    cls = D.cohort(ds, "is_delayed").where(F.col("split") == "train").agg(F.avg("is_delayed").alias("delayed_rate"))
    reg = D.cohort(ds, "total_duration_hours").where(F.col("split") == "train")
    med = exact_quantiles(reg, [], "total_duration_hours", {"median_duration_hours": 0.5})
    # two one-row results combined by union + aggregate (no join)
    u = cls.unionByName(med, allowMissingColumns=True)
    return u.agg(F.max("delayed_rate").alias("delayed_rate"), F.max("median_duration_hours").alias(
        "median_duration_hours"))


@register("prior_baseline_metrics", S.with_ctes(f"""
SELECT 'validation' AS split, count(*) AS row_count,
       {r("avg(((SELECT avg(is_delayed) FROM " + _COH + " AND is_delayed IS NOT NULL AND split = 'train') - is_delayed) ^ 2)")}
         AS brier
FROM {_COH} AND is_delayed IS NOT NULL AND split = 'validation'""", "dsx"))
def prior_baseline_metrics(spark, sf_dir):
    """M3: the train class rate as the probability for every validation row; Brier (E5)."""
    coh = ML.materialize(D.cohort(_dataset(spark, sf_dir), "is_delayed").select("split", "is_delayed"))  # read twice
    prior = coh.where(F.col("split") == "train").agg(F.avg("is_delayed").alias("prior")).first()["prior"]  # scalar
    val = coh.where(F.col("split") == "validation")
    return val.groupBy(F.lit("validation").alias("split")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg((F.lit(float(prior)) - F.col("is_delayed")) ** 2).alias("brier"))


@register("median_baseline_metrics", S.with_ctes(f"""
SELECT 'validation' AS split, count(*) AS row_count,
       {r("avg(abs(total_duration_hours - m))")} AS mae,
       {r("quantile_cont(abs(total_duration_hours - m), 0.5)")} AS median_ae,
       {r("sqrt(avg((total_duration_hours - m) ^ 2))")} AS rmse,
       {r("quantile_cont(abs(total_duration_hours - m), 0.9)")} AS p90_abs_error
FROM (SELECT *, (SELECT quantile_cont(total_duration_hours, 0.5) FROM {_COH} AND total_duration_hours IS NOT NULL
                 AND split = 'train') AS m FROM {_COH} AND total_duration_hours IS NOT NULL AND split = 'validation')""",
                                                   "dsx"))
def median_baseline_metrics(spark, sf_dir):
    """M7 + E4: train median hours predicted for every validation row."""
    coh = ML.materialize(ML.with_label(D.cohort(_dataset(spark, sf_dir), "total_duration_hours"), "total_duration_hours").select("split", "label"))
    fr = ML.fit_regressor(coh.where(F.col("split") == "train"), "median")
    return ML.regression_eval(fr, coh.where(F.col("split") == "validation")).select(
        "split", "row_count", "mae", "median_ae", "rmse", "p90_abs_error")


# Parameters of the registered fits: 300 trees of unlimited depth with 10 rows a leaf; 100 boosting steps; 5 time folds.
FOREST = {"n_estimators": 300, "max_depth": None, "min_samples_leaf": 10, "max_features": "sqrt"}
BOOSTING = {"max_iter": 100, "learning_rate": 0.1, "max_leaf_nodes": 31, "max_depth": None, "min_samples_leaf": 20, "l2_regularization": 0.0}


@register("logreg_training")
def logreg_training(spark, sf_dir):
    """Logistic regression with time-fold OOF, calibration, threshold."""
    _, met = ML.train_classifier(_dataset(spark, sf_dir), "logreg", {"C": 1.0}, n_splits=5)
    return met


@register("forest_training")
def forest_training(spark, sf_dir):
    """M5 + M16: balanced random forest (sqrt features, 10 rows per leaf) through the same flow."""
    return ML.train_classifier(_dataset(spark, sf_dir), "rf", FOREST, n_splits=5, balanced=True)[1]


@register("regression_training")
def regression_training(spark, sf_dir):
    """Elastic net raw and on log1p hours, forest and boosting, with 5 time folds; ranked by MAE."""
    ds = ML.materialize(_dataset(spark, sf_dir))
    out = None
    for order, (name, kind, params, log) in enumerate((
            ("enet", "enet", {"alpha": 0.5, "l1_ratio": 0.5}, False), ("enet_log1p", "enet", {"alpha": 0.5, "l1_ratio": 0.5}, True),
            ("forest", "rf", {**FOREST, "max_features": 1.0}, False), ("boosting", "gbt", BOOSTING, False)), 1):
        m = ML.train_regressor(ds, kind, params, 5, log)[1].withColumns({"model": F.lit(name), "model_order": F.lit(order)})
        out = m if out is None else out.unionByName(m)
    return M.pick_winner(out, "mae", higher_is_better=False)


def _fitted(spark, sf_dir):
    ds = ML.materialize(_dataset(spark, sf_dir))
    coh = ML.with_label(D.cohort(ds, "is_delayed"), "is_delayed")
    clf = ML.fit_classifier(coh.where(F.col("split") == "train"), "logreg", {"C": 1.0})
    rcoh = ML.with_label(D.cohort(ds, "total_duration_hours"), "total_duration_hours")
    reg = ML.fit_regressor(rcoh.where(F.col("split") == "train"), "enet", {"alpha": 0.5, "l1_ratio": 0.5}, True)
    return ds, clf, reg


@register("batch_scores")
def batch_scores(spark, sf_dir):
    """X1 + P17-P20: score every usable opening snapshot in one pass (classification only with an SLA)."""
    ds, clf, reg = _fitted(spark, sf_dir)
    feats = D.scoring_features(V.snapshot_view(spark, sf_dir)).where(F.col("feature_error").isNull()).drop("feature_error")
    return ML.score_cases(feats, clf, reg).select(
        "external_id", "delay_probability", "risk_score", "risk_level", "predicted_is_delayed", "predicted_hours",
        "ok", "error_code")


# A fixed linear model on the raw features, so that SQL can follow every scoring rule.
_Z = "-0.8 + 0.004 * least(coalesce(sla_duration_hours, 100.0), 500.0) + 0.05 * open_weekday - 0.03 * open_hour + CASE WHEN source = 'asia' THEN 0.6 ELSE 0.0 END"
_HOURS = ("CASE WHEN open_month = 7 AND open_weekday = 3 THEN NULL ELSE 40.0 - 6.0 * open_month + 0.5 * coalesce(sla_duration_hours, 0.0) END")
_P_STD, _HOURS_STD = "0.02 + 0.01 * open_weekday", "5.0 + open_month"


def _fixed_scores(features, keep):
    s = features.withColumns({"p": F.expr(f"1 / (1 + exp(-({_Z})))"), "y_raw": F.expr(f"CAST({_HOURS} AS DOUBLE)"),
                              "p_std": F.expr(f"CAST({_P_STD} AS DOUBLE)"), "hours_std": F.expr(f"CAST({_HOURS_STD} AS DOUBLE)")})
    return ML.decide_scores(s, keep, C.DEFAULT_THRESHOLD)


def _fixed_sql(source, keep, has_sla):
    p, h = "delay_probability", "predicted_hours"
    score = f"CASE WHEN {p} IS NOT NULL THEN CAST(least(greatest(round_even({p} * 100, 0), 0), 100) AS BIGINT) END"
    return f"""
fx AS (SELECT *, CASE WHEN {has_sla} THEN 1 / (1 + exp(-({_Z}))) END AS {p}, greatest(CAST({_HOURS} AS DOUBLE), 0.0) AS h0,
              CAST({_HOURS} AS DOUBLE) AS raw, CAST({_P_STD} AS DOUBLE) AS ps, CAST({_HOURS_STD} AS DOUBLE) AS hs FROM {source}),
fy AS (SELECT *, CASE WHEN raw IS NULL THEN NULL ELSE h0 END AS {h} FROM fx)
SELECT {keep}, {r(p)} AS {p}, {score} AS risk_score,
       CASE WHEN {p} IS NULL THEN NULL WHEN {score} <= {C.RISK_LOW_MAX} THEN 'low' WHEN {score} <= {C.RISK_MEDIUM_MAX} THEN 'medium' ELSE 'high' END AS risk_level,
       CAST(CASE WHEN {p} IS NULL THEN NULL WHEN {p} >= {C.DEFAULT_THRESHOLD} THEN 1 ELSE 0 END AS BIGINT) AS predicted_is_delayed,
       {r(h)} AS {h},
       {r(f"CASE WHEN {p} IS NOT NULL THEN greatest({p} - 2 * ps, 0.0) END")} AS probability_lower,
       {r(f"CASE WHEN {p} IS NOT NULL THEN least({p} + 2 * ps, 1.0) END")} AS probability_upper,
       {r(f"CASE WHEN {h} IS NOT NULL THEN greatest({h} - 2 * hs, 0.0) END")} AS hours_lower,
       {r(f"CASE WHEN {h} IS NOT NULL THEN greatest({h} + 2 * hs, 0.0) END")} AS hours_upper,
       CAST(CASE WHEN {h} IS NULL THEN 0 ELSE 1 END AS BIGINT) AS ok,
       CASE WHEN {h} IS NULL THEN 'INVALID_REGRESSION_PREDICTION' END AS error_code
FROM fy"""


@register("fixed_model_scores", S.with_ctes("", "sfx").rstrip() + "," + _fixed_sql(
    "(SELECT * FROM sfx WHERE feature_error = 0)", "external_id", "has_sla = 1"))
def fixed_model_scores(spark, sf_dir):
    """X1 + P17-P21 on a fixed linear model: every usable opening snapshot, with both intervals."""
    feats = D.scoring_features(V.snapshot_view(spark, sf_dir)).where(F.col("feature_error").isNull())
    return _fixed_scores(feats, ["external_id"])


def _scenario_sql():
    from docket.plans.q_interact import _SC_SQL

    merged = ("(SELECT scenario_id, process_id, m_source AS source, open_month, m_open_weekday AS open_weekday, m_open_hour AS open_hour, "
              "m_sla AS sla_duration_hours FROM scm WHERE reject_code IS NULL)")
    return S.with_ctes("", "preds", "sfx").rstrip() + "," + _SC_SQL + "," + _fixed_sql(
        merged, "scenario_id, process_id, 'simulation' AS prediction_context", "sla_duration_hours IS NOT NULL")


@register("scenario_scores", _scenario_sql())
def scenario_scores(spark, sf_dir):
    """Every valid scenario scored on its effective features (SLA rule: effective hours, Q6)."""
    from docket.operators import interact as I
    from docket.plans import q_interact as QI

    checked = I.override_rules(QI._scenarios(spark, sf_dir), I.known_values(V.catalog_view(spark, sf_dir)))
    merged = I.scenario_merge(checked, V.prediction_view(spark, sf_dir), QI._features(spark, sf_dir))["merged"]
    return _fixed_scores(merged, ["scenario_id", "process_id", "prediction_context"])


@register("linear_importance")
def linear_importance(spark, sf_dir):
    """X4 + X8 + P23: |coefficient| of the logistic model per raw feature (max over its one-hot columns), top 10 with labels."""
    _, clf, _ = _fitted(spark, sf_dir)
    rows = [(n.split("=")[0], n, float(v)) for n, v in ML.linear_importance(clf)]  # model size, not data
    df = spark.createDataFrame(rows, "feature string, column string, importance double")
    from docket.operators import explain as EX

    return EX.importance_table(df.groupBy("feature").agg(F.max("importance").alias("importance")), 10)


@register("permutation_importance")
def permutation_importance(spark, sf_dir):
    """X3 + X8: drop in validation average precision per shuffled raw feature (5 repeats), ranked with labels."""
    from docket.operators import explain as EX

    ds, clf, _ = _fitted(spark, sf_dir)
    val = ML.with_label(D.cohort(ds, "is_delayed"), "is_delayed").where(F.col("split") == "validation")
    imp = EX.permutation_importance(lambda df: clf.scores(df), val.select("external_id", "label", *C.ALL_FEATURES))
    return EX.importance_table(imp, 10)


def _fixed_permutation_sql():
    from docket.operators.explain import shuffle_factors
    from docket.plans.q_metrics import _rank_sql

    pairs = [(f, k) for f in C.ALL_FEATURES for k in range(C.PERMUTATION_REPEATS)]
    p = f"round(1 / (1 + exp(-({_Z}))), 6)"
    parts = [f"SELECT '{f}:{k}' AS g, is_delayed AS y, {p} AS p FROM (SELECT b.* REPLACE (d.{f} AS {f}) FROM b JOIN b d "
             f"ON d.pos = ({a} * (b.pos + 1)) % (SELECT count(*) FROM b))" for (f, k), a in zip(pairs, shuffle_factors(len(pairs)))]
    return f"""
b AS (SELECT *, row_number() OVER (ORDER BY external_id) - 1 AS pos FROM dsx
      WHERE schema_error = 0 AND is_delayed IS NOT NULL AND split = 'validation'),
sc AS (SELECT 'base' AS g, is_delayed AS y, {p} AS p FROM b UNION ALL {" UNION ALL ".join(parts)}),""" + _rank_sql("sc", "g") + f"""
SELECT split_part(g, ':', 1) AS feature, {r("avg(base - pr_auc)")} AS importance, {r("stddev_pop(base - pr_auc)")} AS importance_std
FROM rk, (SELECT pr_auc AS base FROM rk WHERE g = 'base') WHERE g <> 'base' GROUP BY 1"""


@register("permutation_fixed_scorer", S.with_ctes("", "dsx").rstrip() + "," + _fixed_permutation_sql())
def permutation_fixed_scorer(spark, sf_dir):
    """X3 on the fixed linear model: mean and spread of the drop in average precision for every raw feature."""
    from docket.operators import explain as EX

    val = ML.with_label(D.cohort(_dataset(spark, sf_dir), "is_delayed"), "is_delayed").where(F.col("split") == "validation")
    return EX.permutation_importance(lambda df: df.withColumn("p", F.expr(f"round(1 / (1 + exp(-({_Z}))), 6)")),
                                     val.select("external_id", "label", *C.ALL_FEATURES))


def _fitted_forest(spark, sf_dir):
    """The balanced FOREST of the whole train split and the usable cases; the forest is stored under the fingerprint (A17) of its rows and read again."""
    from docket.operators import trees as T
    from docket.session import ensure_checkpoint_dir
    from docket.sources.sinks import _hadoop

    ds = ML.materialize(_dataset(spark, sf_dir))
    mark = D.dataset_fingerprint(ds, "is_delayed", C.TEST_CUTOFF).first()["fingerprint"]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{mark}-{FOREST['n_estimators']}"
    fs, done = _hadoop(spark, f"{path}/record/_SUCCESS")
    if not fs.exists(done):
        train = ML.with_label(D.cohort(ds, "is_delayed"), "is_delayed").where(F.col("split") == "train")
        folded = M.time_folds(train.select("external_id", "created_at", "label", *C.ALL_FEATURES), 1)
        fs.delete(_hadoop(spark, path)[1], True)  # what a broken run left
        ML.tree_models(folded, "rf", True, [FOREST], 0, balanced=True, final=True)[0, 0].save_to(path)
    return T.load_forest(spark, path), ds.where(F.col("schema_error").isNull()).select("external_id", *C.ALL_FEATURES)


@register("forest_spread")
def forest_spread(spark, sf_dir):
    """X2 + P21: per-tree spread of a random forest and the +-2 std probability interval, every usable case."""
    from docket.functions import exprs as X

    forest, feats = _fitted_forest(spark, sf_dir)
    scored = forest.transform(feats, "p", "tree_std")  # this forest is not calibrated: its mean is its probability
    lo, hi = X.prob_interval("p", "tree_std")
    return scored.select("external_id", F.col("p").alias("tree_mean"), "tree_std", lo.alias("p_lower"), hi.alias("p_upper"))


@register("forest_shap")
def forest_shap(spark, sf_dir):
    """X5 + X8: TreeSHAP contributions per raw feature for every usable case, top 3 with direction and label."""
    from docket.operators import explain as EX
    from docket.operators import shap as SH

    forest, feats = _fitted_forest(spark, sf_dir)
    lab = EX.feature_label_table(spark)
    return SH.shap_table(SH.ensemble_shap(feats, forest, "external_id"), "external_id", 3).join(F.broadcast(lab), "feature", "left").select(
        "external_id", "rank", "feature", F.coalesce("label", "feature").alias("label"), "contribution", "direction",
        "base_value")


@register("boosting_training")
def boosting_training(spark, sf_dir):
    """M6: gradient-boosted classifier through the same fold / calibration / threshold flow."""
    return ML.train_classifier(_dataset(spark, sf_dir), "gbt", BOOSTING, n_splits=5)[1]


#: Candidates and time folds of every search.
CANDIDATES, SEARCH_FOLDS = 5, 5


def _search_rows(spark, sf_dir, target):
    coh = ML.with_label(D.cohort(_dataset(spark, sf_dir), target), target).where(F.col("split") == "train")
    # every fit and every fold's scoring reads the rows in their order: they are sorted once
    return ML.materialize(M.time_folds(ML.materialize(coh.select("external_id", "created_at", "label", *C.ALL_FEATURES)), SEARCH_FOLDS))


def _marked(best, table):
    return table.withColumn("is_best", (F.col("params") == F.lit(str(best))).cast("int"))


def _classifier_search(spark, sf_dir, kind, balanced=False):
    return _marked(*ML.search(_search_rows(spark, sf_dir, "is_delayed"), kind, C.SEARCH_SPACES[kind], CANDIDATES, SEARCH_FOLDS, balanced))


def _regressor_search(spark, sf_dir, kind, log1p=False):
    space = C.SEARCH_SPACES["rf_regressor" if kind == "rf" else kind]
    return _marked(*ML.search_regressor(_search_rows(spark, sf_dir, "total_duration_hours"), kind, space, CANDIDATES, SEARCH_FOLDS, log1p))


@register("hyperparameter_search")
def hyperparameter_search(spark, sf_dir):
    """Seeded random draws of the regularisation strength, scored by mean OOF PR-AUC over time folds."""
    return _classifier_search(spark, sf_dir, "logreg")


@register("forest_search")
def forest_search(spark, sf_dir):
    """Five seeded draws from the forest's grid (class weights included), scored by mean OOF PR-AUC."""
    return _classifier_search(spark, sf_dir, "rf")


@register("boosting_search")
def boosting_search(spark, sf_dir):
    """Five seeded draws from the boosting grid, scored by mean OOF PR-AUC."""
    return _classifier_search(spark, sf_dir, "gbt")


@register("boosting_selection")
def boosting_selection(spark, sf_dir):
    """The boosting search, its best parameters refitted, calibrated and validated."""
    return ML.search_and_train(ML.materialize(_dataset(spark, sf_dir)), "gbt", C.SEARCH_SPACES["gbt"], CANDIDATES, SEARCH_FOLDS)[2]


@register("enet_regressor_search")
def enet_regressor_search(spark, sf_dir):
    """Five seeded draws from the elastic net's grid on log1p hours, scored by mean OOF MAE."""
    return _regressor_search(spark, sf_dir, "enet", log1p=True)


@register("forest_regressor_search")
def forest_regressor_search(spark, sf_dir):
    """Five seeded draws from the forest's grid, scored by mean OOF MAE."""
    return _regressor_search(spark, sf_dir, "rf")


@register("boosting_regressor_search")
def boosting_regressor_search(spark, sf_dir):
    """Five seeded draws from the boosting grid, scored by mean OOF MAE."""
    return _regressor_search(spark, sf_dir, "gbt")


def _gram_sql():
    entry = lambda name, value: "{'n': " + name + ", 'v': CAST(" + value + " AS DOUBLE)}"
    z = [entry(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), '{C.MISSING_CODE}')", "1") for c in C.CATEGORICAL_FEATURES]
    z += [x for c in C.NUMERIC_FEATURES for x in (entry(f"'{c}'", f"coalesce({c}, 0)"), entry(f"'{c} is null'", f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END"))]
    z += [entry("'1'", "1"), entry("'label'", "total_duration_hours")]
    k, size = SEARCH_FOLDS, f"(n // {SEARCH_FOLDS + 1})"
    return S.with_ctes("", "dsx").rstrip() + f""",
t AS (SELECT *, row_number() OVER (ORDER BY created_at, external_id) - 1 AS pos, count(*) OVER () AS n
      FROM {_COH} AND total_duration_hours IS NOT NULL AND split = 'train'),
z AS (SELECT CASE WHEN pos < n - {k} * {size} THEN 0 ELSE 1 + (pos - (n - {k} * {size})) // {size} END AS segment, [{", ".join(z)}] AS v FROM t),
x AS (SELECT segment, v, unnest(v) AS x FROM z),
y AS (SELECT segment, x, unnest(v) AS y FROM x)
SELECT segment, x.n AS a, y.n AS b, {r("sum(x.v * y.v)")} AS total FROM y GROUP BY ALL HAVING sum(x.v * y.v) <> 0"""


@register("gram_sums", _gram_sql())
def gram_sums(spark, sf_dir):
    """Sums of products of all one-hot levels, numbers, NULL marks, 1 and the hours, per time segment of the train split."""
    rows = _search_rows(spark, sf_dir, "total_duration_hours")
    columns = G.fit_columns(rows)
    names = F.array(*[F.lit(n) for n in columns.names])
    return G.gram_sums(rows, columns, G.segment_of(), F.col("label")).select("segment", names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "total")


@register("isotonic_steps", S.with_ctes("", "dsx").rstrip() + f""",
sc AS (SELECT round(1 / (1 + exp(-({_Z}))), 2) AS x, is_delayed AS y FROM {_COH} AND is_delayed IS NOT NULL),
d AS (SELECT x, sum(y) AS s, count(*) AS w FROM sc GROUP BY x),
c AS (SELECT x, s, w, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM d),
m AS (SELECT i.x, j.x AS start, min((k.cs - j.cs + j.s) / (k.cw - j.cw + j.w)) AS low
      FROM c i JOIN c j ON j.x <= i.x JOIN c k ON k.x >= i.x GROUP BY i.x, j.x)
SELECT x, {r("max(low)")} AS value FROM m GROUP BY x""")
def isotonic_steps(spark, sf_dir):
    """Isotonic steps of the delay label on the fixed model's score (two decimals) over all usable cases, and the value at every score."""
    from docket.operators import isotonic as I

    coh = D.cohort(_dataset(spark, sf_dir), "is_delayed").select(F.round(F.expr(f"1 / (1 + exp(-({_Z})))"), 2).alias("x"), F.col("is_delayed").alias("y"))
    coh = ML.materialize(coh)  # read by the fit and by the scores
    steps = I.fit(coh, "x", "y")
    return steps.transform(coh.select("x").distinct(), "x", "value")
