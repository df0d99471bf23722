"""Model preparation, training, calibration and scoring on Spark MLlib.

Design
* The linear models are MLlib estimators (distributed); the driver only loops over a
  handful of folds / candidates and keeps small per-feature statistics.  The flows fit forests and boosting with
  :mod:`docket.operators.trees`: all folds and candidates at once over one binned table.
* Preprocessing (:func:`fit_prep`) follows the reference semantics:
  categorical NULL -> 'missing', one-hot with an all-zero row for an unseen
  category (StringIndexer keep + OneHotEncoder dropLast drops exactly the
  unseen bucket); numerics get the *exact* train median, then are scaled by
  the population standard deviation of the imputed train column.
* Labels: ``is_delayed`` (classification), ``total_duration_hours``
  (regression, optionally on log1p).
"""

from __future__ import annotations

import dataclasses
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket import config as C
from docket.functions import exprs as X
from docket.operators import gram as G
from docket.operators import isotonic as I
from docket.operators import logistic as LG
from docket.operators import metrics as M
from docket.operators import trees as T
from docket.operators.dataset import evaluated_once
from docket.operators.ordering import exact_quantiles

MAX_FOREST_DEPTH = 30  # MLlib limit; "unlimited" maps here
BOOSTING_DEPTH = 5  # for boosting without a depth: 31 leaves of the usual histogram booster


@dataclasses.dataclass
class PrepModel:
    """Fitted preprocessing: category indexers + numeric statistics (a few scalars)."""

    encoder: PipelineModel
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    categorical: list[str]
    numeric: list[str]

    def transform(self, df: DataFrame, out_col: str = "features") -> DataFrame:
        d = df.withColumns({f"_c_{c}": F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_CODE))
                            for c in self.categorical})
        d = d.withColumns({
            f"_n_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - F.lit(self.means[c]))
            / F.lit(self.scales[c]) for c in self.numeric})
        d = self.encoder.transform(d)
        if out_col != "features":
            d = d.withColumnRenamed("features", out_col)
        return d.drop(*[f"_c_{c}" for c in self.categorical], *[f"_i_{c}" for c in self.categorical],
                      *[f"_o_{c}" for c in self.categorical], *[f"_n_{c}" for c in self.numeric])

    def feature_names(self) -> list[str]:
        names = []
        for c, model in zip(self.categorical, self.encoder.stages[: len(self.categorical)]):
            names += [f"{c}={lab}" for lab in model.labels]
        return names + list(self.numeric)


def fit_prep(train: DataFrame, categorical: Sequence[str] = C.CATEGORICAL_FEATURES,
             numeric: Sequence[str] = C.NUMERIC_FEATURES) -> PrepModel:
    """M1 + M2 fitted on ``train`` only."""
    categorical, numeric = list(categorical), list(numeric)
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("x")) for c in numeric])).alias("kv")).select("kv.*")
    med = {r["f"]: r["median"] for r in exact_quantiles(long, ["f"], "x", {"median": 0.5}).collect()}  # one row per feature
    med = {c: (float(med[c]) if med.get(c) is not None else 0.0) for c in numeric}
    imputed = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med[c])).alias(c) for c in numeric])
    stats = imputed.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric],
                        *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
    means = {c: float(stats[f"m_{c}"] or 0.0) for c in numeric}
    scales = {c: (float(stats[f"s_{c}"]) if stats[f"s_{c}"] else 1.0) for c in numeric}
    stages = [StringIndexer(inputCol=f"_c_{c}", outputCol=f"_i_{c}", handleInvalid="keep",
                            stringOrderType="alphabetAsc") for c in categorical]
    stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical],
                                outputCols=[f"_o_{c}" for c in categorical], dropLast=True, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=[f"_o_{c}" for c in categorical] + [f"_n_{c}" for c in numeric],
                                  outputCol="features"))
    base = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_CODE)).alias(f"_c_{c}")
                          for c in categorical], *[F.lit(0.0).alias(f"_n_{c}") for c in numeric])
    enc = Pipeline(stages=stages).fit(base)
    return PrepModel(enc, med, means, scales, categorical, numeric)


# --- estimators --------------------------------------------------------------------------
def class_weights(train: DataFrame, label: str = "label") -> dict[float, float]:
    """Balanced weight per class = n / (n_classes * n_class) (one row per class read back)."""
    counts = {r[label]: r["_n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).collect()}
    total = sum(counts.values())
    return {k: total / (len(counts) * v) for k, v in counts.items()}


def _depth(depth: int | None, unlimited: int) -> int:
    """A requested depth; None ("no limit") maps to ``unlimited``.  MLlib goes no deeper than 30."""
    if depth is None:
        return unlimited
    if not 0 < int(depth) <= MAX_FOREST_DEPTH:
        raise ValueError(f"max_depth must be between 1 and {MAX_FOREST_DEPTH}, not {depth}")
    return int(depth)


def _subset(max_features) -> str:
    """Features tried per split: a rule name, or a share of them (1.0 or None: all)."""
    return "all" if max_features in (None, 1.0) else str(max_features)


def classifier(kind: str, n_train: int, params: dict | None = None, weight_col: str | None = None, seed: int = 42):
    """M4 / M5 / M6 estimator objects with the reference parameter mappings."""
    p = dict(params or {})
    w = {"weightCol": weight_col} if weight_col else {}
    if kind == "logreg":
        c = float(p.get("C", 1.0))
        return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (c * max(n_train, 1)),
                                  elasticNetParam=0.0, standardization=False, maxIter=int(p.get("max_iter", 2000)),
                                  tol=1e-8, **w)
    if kind == "rf":
        return RandomForestClassifier(
            featuresCol="features", labelCol="label", numTrees=int(p.get("n_estimators", 100)),
            maxDepth=_depth(p.get("max_depth"), MAX_FOREST_DEPTH), minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
            featureSubsetStrategy=_subset(p.get("max_features", "sqrt")), seed=seed, **w)
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=int(p.get("max_iter", 100)),
                             maxDepth=_depth(p.get("max_depth"), BOOSTING_DEPTH), stepSize=float(p.get("learning_rate", 0.1)),
                             minInstancesPerNode=int(p.get("min_samples_leaf", 20)), seed=seed, **w)
    raise ValueError(f"unknown classifier {kind!r}")


def regressor(kind: str, label_std: float | None = None, params: dict | None = None, seed: int = 42):
    """M8 / M9 estimators.  Elastic net maps (alpha, l1_ratio) to MLlib's scaled penalty (M8)."""
    p = dict(params or {})
    if kind == "enet":
        a, r = float(p.get("alpha", 0.5)), float(p.get("l1_ratio", 0.5))
        l1 = a * r
        l2 = a * (1 - r) * float(label_std or 1.0)
        reg = l1 + l2
        return LinearRegression(featuresCol="features", labelCol="label", regParam=reg,
                                elasticNetParam=(l1 / reg) if reg > 0 else 0.0, standardization=False,
                                solver="l-bfgs", maxIter=int(p.get("max_iter", 5000)), tol=1e-9)
    if kind == "rf":
        return RandomForestRegressor(featuresCol="features", labelCol="label",
                                     numTrees=int(p.get("n_estimators", 100)),
                                     maxDepth=_depth(p.get("max_depth"), MAX_FOREST_DEPTH),
                                     minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                                     featureSubsetStrategy=_subset(p.get("max_features", 1.0)), seed=seed)
    if kind == "gbt":
        return GBTRegressor(featuresCol="features", labelCol="label", maxIter=int(p.get("max_iter", 100)),
                            maxDepth=_depth(p.get("max_depth"), BOOSTING_DEPTH), stepSize=float(p.get("learning_rate", 0.1)),
                            minInstancesPerNode=int(p.get("min_samples_leaf", 20)), seed=seed)
    raise ValueError(f"unknown regressor {kind!r}")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it back (lineage cut)."""
    from docket.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def prob1(col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


# --- classification flow -------------------------------------------------------------------
@dataclasses.dataclass
class FittedClassifier:
    kind: str
    prep: PrepModel | None  # trees bin the raw features themselves
    model: object
    sigmoid: object | None = None
    isotonic: object | None = None
    calibration: str = "uncalibrated"
    threshold: float = C.DEFAULT_THRESHOLD

    def raw_scores(self, df: DataFrame) -> DataFrame:
        if isinstance(self.model, (T.Ensemble, T.StoredForest, LG.LogisticModel)):
            return self.model.transform(df, "p_raw")
        return self.model.transform(self.prep.transform(df)).withColumn("p_raw", prob1()).drop(
            "features", "rawPrediction", "probability", "prediction")

    def scores(self, df: DataFrame) -> DataFrame:
        s = self.raw_scores(df)
        return apply_calibration(s, "p_raw", self.calibration, self.sigmoid, self.isotonic)


def with_label(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("label", F.col(target).cast("double"))


def fit_classifier(train: DataFrame, kind: str, params: dict | None = None, balanced: bool = False,
                   seed: int = 42, prep: PrepModel | None = None) -> FittedClassifier:
    """Fit prep (unless given) + estimator on one training frame (has ``label``)."""
    prep = prep or fit_prep(train)
    t = prep.transform(train)
    wcol = None
    if balanced:
        w = class_weights(train)
        m = F.create_map(*[x for k, v in w.items() for x in (F.lit(float(k)), F.lit(float(v)))])
        t = t.withColumn("weight", m[F.col("label")])
        wcol = "weight"
    n = train.count()
    model = classifier(kind, n, params, wcol, seed).fit(t)
    return FittedClassifier(kind, prep, model)


TREES = ("rf", "gbt")
_AT_LEAST = {"n_estimators": 1, "max_iter": 1, "max_depth": 1, "max_leaf_nodes": 2, "min_samples_leaf": 1, "min_samples_split": 2, "l2_regularization": 0, "learning_rate": 0}


def tree_spec(model: int, kind: str, classes: bool, params: dict | None = None, below: int | None = None, log1p: bool = False,
              balanced: bool = False, seed: int = 42) -> T.Spec:
    """M5 / M6 / M9: a checked :class:`trees.Spec`; ``None`` as depth or number of leaves means no limit."""
    p = dict(params or {})
    for name, least in _AT_LEAST.items():
        if p.get(name) is not None and p[name] < least:
            raise ValueError(f"{name} must be at least {least}, not {p[name]}")
    if kind == "rf" and classes and balanced:
        p.setdefault("class_weight", "balanced")
    return T.Spec(model, kind, classes, tuple(p.items()), below, log1p, seed)


def tree_models(folded: DataFrame, kind: str, classes: bool, candidates: Sequence[dict | None], n_splits: int, balanced: bool = False,
                log1p: bool = False, final: bool = False) -> dict[tuple[int, int], T.Ensemble | T.StoredForest]:
    """(candidate, fold) -> ensemble, all fitted at once; fold ``n_splits`` is the fit on all rows (``final``).  Forests are stored ones."""
    at = folded.select("first_test_index", "fold_test_size").first()  # the same in every row
    layout = T.fit_layout(folded)
    specs, keys = [], []
    for c, params in enumerate(candidates):
        for k in range(n_splits + (1 if final else 0)):
            below = at["first_test_index"] + k * at["fold_test_size"] if k < n_splits else None
            keys.append((c, k))
            specs.append(tree_spec(len(specs), kind, classes, params, below, log1p, balanced))
    if kind == "rf":
        return dict(zip(keys, T.fit_stored(folded, layout, specs)))
    fits = T.fit_models(folded, layout, specs)
    return {key: T.Ensemble.of(layout, fits, m) for m, key in enumerate(keys)}


def hour_models(folded: DataFrame, kind: str, candidates: Sequence[dict | None], n_splits: int, log1p: bool = False, final: bool = False) -> dict:
    """(candidate, fold) -> fitted elastic net, forest or booster; fold ``n_splits`` is the fit on all rows."""
    if kind in TREES:
        return tree_models(folded, kind, False, candidates, n_splits, log1p=log1p, final=final)
    if kind == "enet":
        for p in candidates:
            if (p or {}).get("alpha", 0.5) < 0 or not 0 <= (p or {}).get("l1_ratio", 0.5) <= 1:
                raise ValueError(f"alpha must not be negative and l1_ratio lies in [0, 1]: {p}")
        return G.elastic_nets(folded, [{"alpha": 0.5, "l1_ratio": 0.5, **(p or {})} for p in candidates], n_splits, log1p)
    raise ValueError(f"unknown regressor {kind!r}")


def check_logistic(params: dict | None) -> None:
    if not float((params or {}).get("C", 1.0)) > 0:
        raise ValueError(f"C must be positive: {params}")


def logistic_models(folded: DataFrame, candidates: Sequence[dict | None], n_splits: int, balanced: bool = False, final: bool = False) -> dict[tuple[int, int], LG.LogisticModel]:
    """(candidate, fold) -> logistic regression, all fitted side by side; fold ``n_splits`` is the fit on all rows (``final``)."""
    for p in candidates:
        check_logistic(p)
    return LG.fit_all(folded, candidates, n_splits, balanced, final)


def tree_oof(folded: DataFrame, models: dict, n_splits: int, out_col: str) -> DataFrame:
    """Every fold's rows scored by the models of earlier rows: the rows, ``candidate``, ``fold`` and ``out_col``."""
    chunks = {}  # of a fold's rows: all its forests read the same ones

    def one(c: int, k: int, m) -> DataFrame:
        rows = folded.where(F.col("test_fold") == k)
        if isinstance(m, T.StoredForest):
            if k not in chunks:
                chunks[k] = T.packed(rows, m.layout)
            scored = m.transform(rows, out_col, chunks=chunks[k])
        else:
            scored = m.transform(rows, out_col)
        return scored.withColumns({"fold": F.lit(k), "candidate": F.lit(c)})

    return reduce(DataFrame.unionByName, [one(c, k, m) for (c, k), m in models.items() if k < n_splits])


def oof_predictions(folded: DataFrame, kind: str, params: dict | None = None, n_splits: int = 5,
                    balanced: bool = False, preps: Sequence[PrepModel] | None = None) -> DataFrame:
    """Out-of-fold raw probabilities: for each fold fit on earlier rows, score the fold."""
    if kind in TREES:
        return tree_oof(folded, tree_models(folded, kind, True, [params], n_splits, balanced), n_splits, "p_raw")

    def one(k: int) -> DataFrame:
        tr, te = fold_frames(folded, k)
        return fit_classifier(tr, kind, params, balanced, prep=preps[k] if preps else None).raw_scores(te).withColumn("fold", F.lit(k))

    return reduce(DataFrame.unionByName, _together(folded.sparkSession, one, n_splits))


def _oof_and_final(folded: DataFrame, train: DataFrame, kind: str, params: dict | None, n_splits: int, balanced: bool) -> tuple[DataFrame, FittedClassifier]:
    """Out-of-fold probabilities and the fit on all rows."""
    if kind in TREES:
        models = tree_models(folded, kind, True, [params], n_splits, balanced, final=True)
        return tree_oof(folded, models, n_splits, "p_raw"), FittedClassifier(kind, None, models[0, n_splits])
    if kind == "logreg":
        models = logistic_models(folded, [params], n_splits, balanced, final=True)
        return tree_oof(folded, models, n_splits, "p_raw"), FittedClassifier(kind, None, models[0, n_splits])
    return oof_predictions(folded, kind, params, n_splits, balanced), fit_classifier(train, kind, params, balanced)


def fold_frames(folded: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows that fold ``k`` trains on (all earlier ones) and tests on."""
    return (folded.where(F.col("row_index") < F.col("first_test_index") + k * F.col("fold_test_size")),
            folded.where(F.col("test_fold") == k))


def _together(spark, one, n: int) -> list:
    """``one(0) .. one(n - 1)`` with their Spark jobs side by side; results in order, the first failure is raised."""
    with ThreadPoolExecutor(max_workers=n) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), k) for k in range(n)]]


def fold_metrics(oof: DataFrame) -> DataFrame:
    """M11 summary: PR-AUC / ROC-AUC per fold, then mean and population std."""
    per = M.ranking_metrics(oof.select("fold", F.col("label").cast("int").alias("y"), F.col("p_raw").alias("p")),
                            ["fold"])
    return per.agg(F.avg("pr_auc").alias("cv_pr_auc_mean"), F.stddev_pop("pr_auc").alias("cv_pr_auc_std"),
                   F.avg("roc_auc").alias("cv_roc_auc_mean"), F.stddev_pop("roc_auc").alias("cv_roc_auc_std"))


def fit_calibrators(oof: DataFrame):
    """Sigmoid (logistic regression on logit p, C=1) and isotonic (clipped) fitted on OOF only."""
    d = oof.select(F.col("label"), X.logit("p_raw").alias("z"), F.col("p_raw"))
    n = d.count()
    sig = LogisticRegression(featuresCol="zf", labelCol="label", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                             standardization=False, tol=1e-10, maxIter=200).fit(
        VectorAssembler(inputCols=["z"], outputCol="zf").transform(d))
    return sig, I.fit(d, "p_raw", "label")


def apply_calibration(df: DataFrame, p_col: str, method: str, sig, iso) -> DataFrame:
    """Add ``p`` = calibrated probability (P24 logit for sigmoid; isotonic clips at the ends)."""
    if method == "uncalibrated":
        return df.withColumn("p", F.col(p_col))
    if (sig if method == "sigmoid" else iso) is None:
        raise ValueError(f"no {method} calibrator")
    if method == "sigmoid":
        coef, icpt = float(sig.coefficients[0]), float(sig.intercept)
        return df.withColumn("p", 1.0 / (1.0 + F.exp(-(F.lit(coef) * X.logit(p_col) + F.lit(icpt)))))
    return iso.transform(df, p_col, "p")


def train_classifier(dataset: DataFrame, kind: str, params: dict | None = None, n_splits: int = 5,
                     balanced: bool = False) -> tuple[FittedClassifier, DataFrame]:
    """Whole classification flow: W8 folds -> OOF -> calibration choice (M13) -> threshold
    -> refit on all train (M19) -> validation metrics.  Returns the fitted model and a
    one-row metrics frame.
    """
    from docket.operators.dataset import cohort

    # training data is read many times (folds, refits): materialise it once
    coh = materialize(with_label(cohort(dataset, "is_delayed"), "is_delayed").select(
        "external_id", "created_at", "split", "label", *C.ALL_FEATURES))
    train = coh.where(F.col("split") == "train")
    val = coh.where(F.col("split") == "validation")
    folded = materialize(M.time_folds(train, n_splits))  # sorted once for all fits and folds
    oof, fc = _oof_and_final(folded, train, kind, params, n_splits, balanced)
    oof = oof.persist()
    cv = fold_metrics(oof)
    sig, iso = fit_calibrators(oof)
    fc.sigmoid, fc.isotonic = sig, iso
    vraw = fc.raw_scores(val).select("external_id", F.col("label").cast("int").alias("y"), "p_raw")
    variants = None
    for order, m in enumerate(("uncalibrated", "sigmoid", "isotonic"), start=1):
        v = apply_calibration(vraw, "p_raw", m, sig, iso).select(F.lit("validation").alias("split"), "y", "p",
                                                                  F.lit(m).alias("method"))
        variants = v if variants is None else variants.unionByName(v)
    choice = M.calibration_choice(variants)
    chosen = choice.where(F.col("is_selected") == 1).first()["method"]  # one row
    fc.calibration = chosen
    vp = apply_calibration(vraw, "p_raw", chosen, sig, iso).select(F.lit("validation").alias("split"), "y", "p")
    best = M.threshold_table(vp).where(F.col("is_best") == 1).first()  # one row
    fc.threshold = float(best["cut"])
    met = M.classification_metrics(vp, threshold=fc.threshold)
    out = met.select(F.lit(kind).alias("model"), F.lit(chosen).alias("calibration"),
                     F.lit(fc.threshold).alias("threshold"), "row_count", "roc_auc", "pr_auc", "precision",
                     "recall", "f1", "brier")
    cvr = cv.first()  # one row of fold statistics
    oof.unpersist()
    return fc, out.withColumns({k: F.lit(cvr[k]).cast("double") for k in cv.columns})


def search_and_train(dataset: DataFrame, kind: str, space: dict[str, list], n_candidates: int, n_splits: int = 5) -> tuple[FittedClassifier, dict, DataFrame]:
    """M10 -> M19: search on the train split, then the whole flow (folds, calibration, threshold, refit, validation) on the best parameters."""
    from docket.operators.dataset import cohort

    train = with_label(cohort(dataset, "is_delayed"), "is_delayed").where(F.col("split") == "train")
    folded = materialize(M.time_folds(materialize(train.select("external_id", "created_at", "label", *C.ALL_FEATURES)), n_splits))
    best, _ = search(folded, kind, space, n_candidates, n_splits)
    fitted, metrics = train_classifier(dataset, kind, best, n_splits)
    return fitted, best, metrics.withColumn("params", F.lit(str(best)))


# --- regression ----------------------------------------------------------------------------
@dataclasses.dataclass
class FittedRegressor:
    kind: str
    prep: PrepModel | None
    model: object | None
    log1p: bool = False
    median: float | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Raw prediction ``y_raw`` in hours (expm1 applied for log models; P25)."""
        if self.kind == "median":
            return df.withColumn("y_raw", F.lit(float(self.median)))
        if isinstance(self.model, (T.Ensemble, T.StoredForest, G.LinearModel)):
            return self.model.transform(df, "y_raw")
        t = self.model.transform(self.prep.transform(df))
        y = F.expm1(F.col("prediction")) if self.log1p else F.col("prediction")
        return t.withColumn("y_raw", y).drop("features", "prediction")


def fit_regressor(train: DataFrame, kind: str, params: dict | None = None, log1p: bool = False) -> FittedRegressor:
    """M7 / M8 / M9 on ``train`` with label hours (P25 log1p option)."""
    if kind == "median":
        med = exact_quantiles(train, [], "label", {"m": 0.5}).first()["m"]
        return FittedRegressor("median", None, None, median=float(med))
    t = train.withColumn("label", F.log1p("label")) if log1p else train
    prep = fit_prep(t)
    std = t.agg(F.stddev_samp("label")).first()[0] if kind == "enet" else None
    model = regressor(kind, std, params).fit(prep.transform(t))
    return FittedRegressor(kind, prep, model, log1p)


def oof_hours(folded: DataFrame, kind: str, params: dict | None = None, n_splits: int = 5, log1p: bool = False) -> DataFrame:
    """M11 for hours: each fold predicted by a fit on the rows before it, clamped at 0."""
    return _hours(tree_oof(folded, hour_models(folded, kind, [params], n_splits, log1p), n_splits, "y_raw"))


def _hours(oof: DataFrame) -> DataFrame:
    return oof.select("candidate", "fold", F.col("label").alias("y"), X.clamp_hours("y_raw").alias("yhat"))


def regression_fold_metrics(oof: DataFrame) -> DataFrame:
    """M11 summary for hours: MAE and RMSE per fold, then mean and population std."""
    e = F.abs(F.col("y") - F.col("yhat"))
    per = oof.groupBy("fold").agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return per.agg(F.avg("mae").alias("cv_mae_mean"), F.stddev_pop("mae").alias("cv_mae_std"),
                   F.avg("rmse").alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std"))


def train_regressor(dataset: DataFrame, kind: str, params: dict | None = None, n_splits: int = 5,
                    log1p: bool = False) -> tuple[FittedRegressor, DataFrame]:
    """Whole regression flow: W8 folds -> fold MAE / RMSE -> refit on all train (M19) -> E4 on validation."""
    from docket.operators.dataset import cohort

    coh = materialize(with_label(cohort(dataset, "total_duration_hours"), "total_duration_hours").select(
        "external_id", "created_at", "split", "label", *C.ALL_FEATURES))
    train, val = coh.where(F.col("split") == "train"), coh.where(F.col("split") == "validation")
    folded = materialize(M.time_folds(train, n_splits))  # sorted once for all fits and folds
    models = hour_models(folded, kind, [params], n_splits, log1p, final=True)
    fr, oof = FittedRegressor(kind, None, models[0, n_splits], log1p), _hours(tree_oof(folded, models, n_splits, "y_raw"))
    cv = regression_fold_metrics(oof).first()  # one row
    return fr, regression_eval(fr, val).withColumns({k: F.lit(cv[k]).cast("double") for k in cv.__fields__})


def regression_eval(fr: FittedRegressor, val: DataFrame) -> DataFrame:
    """Clamp predictions at 0, then E4 on the validation rows."""
    p = fr.predict(val).withColumn("yhat", X.clamp_hours("y_raw"))
    return M.regression_metrics(p.select("split", F.col("label").alias("y"), "yhat"))


# --- scoring (X1) -------------------------------------------------------------------------------
def score_cases(features: DataFrame, clf: FittedClassifier, reg: FittedRegressor) -> DataFrame:
    """X1 + P17-P20: one pass over the whole feature table.

    Classification only when the case has an SLA: ``has_sla`` (a deadline is
    there) where the column exists, else the SLA hours, which is the rule of
    scenarios (Q6); calibrated probability, risk score/level, decision at the chosen
    threshold; regression hours clamped at 0 - a non-finite regression
    output marks the row ``ok = 0`` with an error code and nothing else.
    """
    return decide_scores(reg.predict(clf.scores(features)), features.columns, clf.threshold)


def decide_scores(scored: DataFrame, keep: Sequence[str], threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """P17-P20 and the failure rule on a table with a calibrated probability ``p`` and raw hours ``y_raw``.

    With ``p_std`` / ``hours_std`` (X2 spreads) it adds the P21 intervals around
    the calibrated probability and the clamped hours.
    """
    has_sla = F.col("has_sla") == 1 if "has_sla" in scored.columns else F.col("sla_duration_hours").isNotNull()
    # the score, its level and both intervals name these again and again: a row computes each once
    s = evaluated_once(scored, {"delay_probability": F.when(has_sla, F.col("p")), "_hours": F.col("y_raw")})
    s = evaluated_once(s, {"_score": X.risk_score("delay_probability"), "_hours": X.clamp_hours("_hours")})
    hours, score = F.col("_hours"), F.col("_score")
    extra = []
    if "p_std" in s.columns:
        low, high = X.prob_interval("delay_probability", "p_std")
        extra += [low.alias("probability_lower"), high.alias("probability_upper")]
    if "hours_std" in s.columns:
        low, high = X.hours_interval(hours, "hours_std")
        extra += [low.alias("hours_lower"), high.alias("hours_upper")]
    return s.select(
        *keep,
        "delay_probability",
        score.alias("risk_score"), X.risk_level(score).alias("risk_level"),
        X.delay_decision("delay_probability", has_sla, threshold).alias("predicted_is_delayed"),
        hours.alias("predicted_hours"), *extra,
        F.when(hours.isNull(), 0).otherwise(1).alias("ok"),
        F.when(hours.isNull(), F.lit("INVALID_REGRESSION_PREDICTION")).alias("error_code"),
    )


def linear_importance(clf: FittedClassifier) -> list[tuple[str, float]]:
    """|coefficient| per transformed feature name (model size, not data size)."""
    names = clf.prep.feature_names()
    coefs = list(clf.model.coefficients.toArray())
    return sorted(zip(names, [abs(c) for c in coefs]), key=lambda t: -t[1])


def random_candidates(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """Seeded draws from a parameter grid."""
    import itertools

    rng = random.Random(seed)
    keys = list(space)
    grid = [dict(zip(keys, combo)) for combo in itertools.product(*[space[k] for k in keys])]
    if n >= len(grid):
        return grid
    return rng.sample(grid, n)  # distinct grid points, like sampling a finite grid without replacement


def search(folded: DataFrame, kind: str, space: dict[str, list], n_candidates: int, n_splits: int = 5,
           balanced: bool = False) -> tuple[dict, DataFrame]:
    """Mean OOF PR-AUC per candidate; the best (first on ties) wins.

    A candidate whose parameters the estimator refuses stays in the table with
    its error; every other failure is raised.
    """
    if kind in (*TREES, "logreg"):
        def scores(oof: DataFrame) -> DataFrame:
            per = M.ranking_metrics(oof.select("candidate", "fold", F.col("label").cast("int").alias("y"), F.col("p_raw").alias("p")), ["candidate", "fold"])
            return per.groupBy("candidate").agg(F.avg("pr_auc").alias("cv_pr_auc_mean"))

        return _search_together(folded, space, n_candidates, n_splits, "cv_pr_auc_mean", True, "p_raw", scores,
                                lambda cands: tree_models(folded, kind, True, cands, n_splits, balanced) if kind in TREES else logistic_models(folded, cands, n_splits, balanced),
                                lambda cand: tree_spec(0, kind, True, cand) if kind in TREES else check_logistic(cand))
    # the preprocessing of a fold is the same for all candidates
    preps = _together(folded.sparkSession, lambda k: fit_prep(fold_frames(folded, k)[0]), n_splits)
    return _search(folded, space, n_candidates, "cv_pr_auc_mean", True,
                   lambda cand: fold_metrics(oof_predictions(folded, kind, cand, n_splits, balanced, preps)))


def search_regressor(folded: DataFrame, kind: str, space: dict[str, list], n_candidates: int, n_splits: int = 5,
                     log1p: bool = False) -> tuple[dict, DataFrame]:
    """M10 for hours: mean out-of-fold MAE per candidate, the lowest (first on ties) wins."""
    def scores(oof: DataFrame) -> DataFrame:
        per = _hours(oof).groupBy("candidate", "fold").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))
        return per.groupBy("candidate").agg(F.avg("mae").alias("cv_mae_mean"))

    return _search_together(folded, space, n_candidates, n_splits, "cv_mae_mean", False, "y_raw", scores,
                            lambda cands: hour_models(folded, kind, cands, n_splits, log1p), lambda cand: tree_spec(0, kind, False, cand) if kind in TREES else None)


def _search_together(folded: DataFrame, space: dict[str, list], n_candidates: int, n_splits: int, metric: str, higher: bool, column: str,
                     scores, fit, check) -> tuple[dict, DataFrame]:
    """All candidates and folds are fitted together and scored in one go; a candidate that ``check`` refuses keeps its error."""
    candidates, errors = random_candidates(space, n_candidates), {}
    for i, cand in enumerate(candidates):
        try:
            check(cand)
        except ValueError as e:
            errors[i] = str(e)
    fine = [i for i in range(len(candidates)) if i not in errors]
    got = {}
    if fine:
        models = fit([candidates[i] for i in fine])
        got = {fine[r["candidate"]]: r[metric] for r in scores(tree_oof(folded, models, n_splits, column)).collect()}  # one row a candidate
    rows = [(i, str(c), float(got[i]) if got.get(i) is not None else None, errors.get(i)) for i, c in enumerate(candidates)]
    best = min((i for i in got if got[i] is not None), key=lambda i: (-got[i] if higher else got[i], i), default=None)
    return (candidates[best] if best is not None else {}), folded.sparkSession.createDataFrame(rows, f"candidate int, params string, {metric} double, error string")


def _search(folded: DataFrame, space: dict[str, list], n_candidates: int, metric: str, higher: bool, run) -> tuple[dict, DataFrame]:
    rows, best, best_score = [], None, None
    for i, cand in enumerate(random_candidates(space, n_candidates)):
        try:
            score = run(cand).first()[metric]  # one row
        except (ValueError, IllegalArgumentException) as e:
            rows.append((i, str(cand), None, str(e).splitlines()[0][:200]))
            continue
        rows.append((i, str(cand), float(score) if score is not None else None, None))
        if score is not None and (best_score is None or (score > best_score if higher else score < best_score)):
            best, best_score = cand, score
    spark = folded.sparkSession
    return best or {}, spark.createDataFrame(rows, f"candidate int, params string, {metric} double, error string")
