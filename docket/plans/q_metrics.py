"""Registered queries: metrics on deterministic scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket import config as C
from docket.functions import exprs as X
from docket.operators import dataset as D
from docket.operators import metrics as M
from docket.plans import sql as S
from docket.plans import views as V
from docket.plans.registry import r, register

_EPS = C.LOGIT_EPS
_CUTS_SQL = (f"SELECT CAST({C.THRESHOLD_START} AS DOUBLE) + i * CAST({C.THRESHOLD_STEP} AS DOUBLE) AS cut "
             f"FROM range({C.THRESHOLD_CUTS}) t(i)")


def _methods_spark(df):
    """Three deterministic score variants standing in for calibration methods / models."""
    sig = 1.0 / (1.0 + F.exp(-(F.lit(1.2) * X.logit("p") - F.lit(0.3))))
    iso = F.floor(F.round(F.col("p") * 100) / 10) / 10.0  # p is k/100: floor to tenths
    return df.select("split", "y", F.explode(F.array(
        F.struct(F.lit("uncalibrated").alias("method"), F.lit(1).alias("model_order"), F.col("p").alias("p")),
        F.struct(F.lit("sigmoid").alias("method"), F.lit(2).alias("model_order"), sig.alias("p")),
        F.struct(F.lit("isotonic").alias("method"), F.lit(3).alias("model_order"), iso.alias("p")),
    )).alias("m")).select("split", "y", "m.method", "m.model_order", "m.p")


_LOGIT_SQL = f"ln(least(greatest(p, {_EPS}), 1 - {_EPS}) / (1 - least(greatest(p, {_EPS}), 1 - {_EPS})))"
_METHODS_SQL = f"""
meth AS (
  SELECT split, y, 'uncalibrated' AS method, 1 AS model_order, p FROM scored
  UNION ALL SELECT split, y, 'sigmoid', 2, 1.0 / (1.0 + exp(-(1.2 * {_LOGIT_SQL} - 0.3))) FROM scored
  UNION ALL SELECT split, y, 'isotonic', 3, floor(round(p * 100) / 10) / 10.0 FROM scored)"""


def _rank_sql(src: str, grp: str) -> str:
    """AUC (ties 1/2) and average precision from a (grp, p, y) source, via window prefix sums."""
    return f"""
h AS (SELECT {grp}, p, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {grp}, p),
c AS (SELECT *,
        coalesce(sum(pos) OVER (PARTITION BY {grp} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS pos_below,
        coalesce(sum(neg) OVER (PARTITION BY {grp} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS neg_below,
        sum(pos) OVER (PARTITION BY {grp}) AS n_pos, sum(neg) OVER (PARTITION BY {grp}) AS n_neg
      FROM h),
rk AS (SELECT {grp},
         CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN sum(pos * (neg_below + 0.5 * neg)) / (max(n_pos) * max(n_neg)) END AS roc_auc,
         CASE WHEN max(n_pos) > 0 THEN sum(CASE WHEN pos > 0 THEN (pos / n_pos) * ((n_pos - pos_below)
              / ((n_pos + n_neg) - (pos_below + neg_below))) ELSE 0 END) END AS pr_auc
       FROM c GROUP BY {grp})"""


def _conf_sql(src: str, grp: str, t: float) -> str:
    return f"""
cf AS (SELECT {grp}, count(*) AS row_count,
         CAST(sum(CASE WHEN y = 0 AND p < {t} THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN y = 0 AND p >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN y = 1 AND p < {t} THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN y = 1 AND p >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         avg((p - y) * (p - y)) AS brier
       FROM {src} GROUP BY {grp})"""


def _conf_cols(prefix: str = "", hide: str | None = None) -> str:
    def h(x):
        return f"CASE WHEN {hide} THEN NULL ELSE {x} END" if hide else x

    tp, fp, fn, tn = (f"{prefix}{c}" for c in ("tp", "fp", "fn", "tn"))
    return ", ".join([
        f"{h(tn)} AS tn", f"{h(fp)} AS fp", f"{h(fn)} AS fn", f"{h(tp)} AS tp",
        f"{r(h(f'CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0 END'))} AS precision",
        f"{r(h(f'CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0 END'))} AS recall",
        f"{r(h(f'CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0 END'))} AS f1",
        f"{r(h(f'CASE WHEN {prefix}row_count > 0 THEN ({tp} + {tn}) / {prefix}row_count ELSE 0 END'))} AS accuracy",
        f"{r(h(f'{prefix}brier'))} AS brier",
    ])


def _scored(spark, sf_dir):
    return V.scored_view(spark, sf_dir)


_SEALED = "cf.split IN ('test', 'audit')"


@register("classification_metrics", S.with_ctes("", "scored").rstrip() + ", sc AS (SELECT * FROM scored WHERE y IS NOT NULL "
          "AND split IS NOT NULL)," + _conf_sql("sc", "split", C.DEFAULT_THRESHOLD) + "," + _rank_sql("sc", "split") + f"""
SELECT cf.split, cf.row_count, {_conf_cols('cf.', _SEALED)},
       {r(f'CASE WHEN {_SEALED} THEN NULL ELSE rk.roc_auc END')} AS roc_auc,
       {r(f'CASE WHEN {_SEALED} THEN NULL ELSE rk.pr_auc END')} AS pr_auc
FROM cf JOIN rk ON cf.split = rk.split""")
def classification_metrics(spark, sf_dir):
    """E1 + E2 + E3 + E5 per split at threshold 0.35; F9 hides metrics of sealed splits."""
    return M.classification_metrics(_scored(spark, sf_dir))


@register("classification_metrics_unsealed", S.with_ctes("", "scored").rstrip() + ", sc AS (SELECT * FROM scored "
          "WHERE y IS NOT NULL AND split IS NOT NULL)," + _conf_sql("sc", "split", 0.5) + "," + _rank_sql("sc", "split")
          + f"""
SELECT cf.split, cf.row_count, {_conf_cols('cf.')}, {r('rk.roc_auc')} AS roc_auc, {r('rk.pr_auc')} AS pr_auc
FROM cf JOIN rk ON cf.split = rk.split""")
def classification_metrics_unsealed(spark, sf_dir):
    """Final evaluation with the seal lifted (allow_sealed=True), threshold 0.5."""
    return M.classification_metrics(_scored(spark, sf_dir), threshold=0.5, allow_sealed=True)


@register("regression_metrics", S.with_ctes(f"""
SELECT split, count(*) AS row_count,
       {r("CASE WHEN split IN ('test', 'audit') THEN NULL ELSE avg(abs(y_hours - yhat_hours)) END")} AS mae,
       {r("CASE WHEN split IN ('test', 'audit') THEN NULL ELSE quantile_cont(abs(y_hours - yhat_hours), 0.5) END")}
         AS median_ae,
       {r("CASE WHEN split IN ('test', 'audit') THEN NULL ELSE sqrt(avg((y_hours - yhat_hours) ^ 2)) END")} AS rmse,
       {r("CASE WHEN split IN ('test', 'audit') THEN NULL ELSE quantile_cont(abs(y_hours - yhat_hours), 0.9) END")}
         AS p90_abs_error
FROM scored WHERE y_hours IS NOT NULL AND split IS NOT NULL GROUP BY split""", "scored"))
def regression_metrics(spark, sf_dir):
    """E4 with exact linear percentiles (distributed sort, no in-memory percentile buffer)."""
    s = _scored(spark, sf_dir).select("split", F.col("y_hours").alias("y"), F.col("yhat_hours").alias("yhat"))
    return M.regression_metrics(s)


@register("threshold_search", S.with_ctes("", "scored").rstrip() + f""",
cuts AS ({_CUTS_SQL}),
h AS (SELECT split, p, sum(y) AS pos, sum(1 - y) AS neg FROM scored WHERE y IS NOT NULL AND split IS NOT NULL
      GROUP BY split, p),
g AS (SELECT split, sum(pos) AS n_pos FROM h GROUP BY split),
t AS (SELECT g.split, cuts.cut, g.n_pos,
             coalesce((SELECT sum(pos) FROM h WHERE h.split = g.split AND h.p >= cuts.cut), 0) AS tp,
             coalesce((SELECT sum(neg) FROM h WHERE h.split = g.split AND h.p >= cuts.cut), 0) AS fp
      FROM g, cuts),
m AS (SELECT split, cut, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n_pos - tp AS BIGINT) AS fn,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
             CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0 END AS recall,
             CASE WHEN 2 * tp + fp + (n_pos - tp) > 0 THEN 2 * tp / (2 * tp + fp + (n_pos - tp)) ELSE 0 END AS f1
      FROM t)
SELECT split, {r('cut')} AS cut, tp, fp, fn, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1,
       CAST(CASE WHEN row_number() OVER (PARTITION BY split ORDER BY f1 DESC, CASE WHEN f1 = 0 AND abs(cut - 0.5) < 1e-9 THEN 0 ELSE 1 END, cut ASC) = 1 THEN 1 ELSE 0 END AS BIGINT)
         AS is_best
FROM m""")
def threshold_search(spark, sf_dir):
    """F1 at 17 cuts per split; best cut flagged (lowest cut wins ties)."""
    return M.threshold_table(_scored(spark, sf_dir).where(F.col("split").isNotNull()))


@register("calibration_choice", S.with_ctes("", "scored").rstrip() + "," + _METHODS_SQL + f""",
b AS (SELECT split, method, model_order, avg((p - y) * (p - y)) AS brier FROM meth
      WHERE y IS NOT NULL AND split IS NOT NULL GROUP BY split, method, model_order)
SELECT split, method, {r('brier')} AS brier,
       CAST(CASE WHEN row_number() OVER (PARTITION BY split ORDER BY brier, model_order) = 1 THEN 1 ELSE 0 END AS BIGINT)
         AS is_selected
FROM b""")
def calibration_choice(spark, sf_dir):
    """M13 + P24: Brier of three score variants per split; lowest selected (earlier on ties)."""
    m = _methods_spark(_scored(spark, sf_dir).where(F.col("y").isNotNull() & F.col("split").isNotNull()))
    return M.calibration_choice(m)


@register("model_comparison", S.with_ctes("", "scored").rstrip() + "," + _METHODS_SQL + """,
sc AS (SELECT method, model_order, y, p FROM meth WHERE split = 'validation' AND y IS NOT NULL),""" + _rank_sql(
    "sc", "method") + f"""
SELECT method AS model, model_order, {r('pr_auc')} AS pr_auc, {r('roc_auc')} AS roc_auc,
       CAST(row_number() OVER (ORDER BY pr_auc DESC, model_order) AS BIGINT) AS rank,
       CAST(CASE WHEN row_number() OVER (ORDER BY pr_auc DESC, model_order) = 1 THEN 1 ELSE 0 END AS BIGINT) AS is_winner
FROM rk JOIN (SELECT DISTINCT method AS m2, model_order FROM sc) o ON rk.method = o.m2""")
def model_comparison(spark, sf_dir):
    """Rank models by validation PR-AUC, first model wins ties."""
    m = _methods_spark(_scored(spark, sf_dir).where((F.col("split") == "validation") & F.col("y").isNotNull()))
    rk = M.ranking_metrics(m, ["method", "model_order"])
    return M.pick_winner(rk, "pr_auc", True).select(
        F.col("method").alias("model"), "model_order", "pr_auc", "roc_auc", "rank", "is_winner")


@register("time_folds", S.with_ctes("""
SELECT external_id, row_index,
       CASE WHEN row_index >= n - 5 * (n // 6) AND (row_index - (n - 5 * (n // 6))) // (n // 6) < 5
            THEN CAST((row_index - (n - 5 * (n // 6))) // (n // 6) AS BIGINT) END AS test_fold
FROM (SELECT external_id, CAST(row_number() OVER (ORDER BY created_at, external_id) - 1 AS BIGINT) AS row_index,
             count(*) OVER () AS n
      FROM dsx WHERE schema_error = 0 AND is_delayed IS NOT NULL AND split = 'train') t""", "dsx"))
def time_folds(spark, sf_dir):
    """Expanding time folds over the classification train split (distributed index)."""
    ds = D.build_dataset(V.snapshot_view(spark, sf_dir), V.process_view(spark, sf_dir), C.TEST_SPLITS, C.TEST_CUTOFF)
    train = D.cohort(ds, "is_delayed").where(F.col("split") == "train").select("external_id", "created_at")
    return M.time_folds(train, 5).select("external_id", "row_index", "test_fold")


_LIVE_SRC = """
live AS (
  SELECT pv.external_id, CASE WHEN pv.completed_at > pv.deadline THEN 1 ELSE 0 END AS y,
         CASE WHEN d.external_id IS NULL THEN 'skipped' WHEN d.feature_error = 1 THEN 'failed' ELSE 'ok' END AS outcome,
         CASE WHEN pv.o_orderkey % 71 = 3 THEN NULL ELSE s.p END AS p, CAST(year(pv.completed_at) AS VARCHAR) AS evaluated_at
  FROM pv LEFT JOIN sfx d ON pv.external_id = d.external_id
  LEFT JOIN scored s ON pv.external_id = s.external_id
  WHERE pv.completed_at IS NOT NULL AND pv.deadline IS NOT NULL)"""


def _live(spark, sf_dir):
    from docket.operators import interact as I

    pv = V.process_view(spark, sf_dir)
    feats = D.scoring_features(V.snapshot_view(spark, sf_dir))
    # cases 3 mod 71 have no probability (a failed score); all of them stay in the evaluation
    p = F.when(F.col("external_id").cast("long") % 71 != 3, F.col("p"))
    return I.live_cases(pv, feats, _scored(spark, sf_dir).select("external_id", p.alias("p")))


@register("live_evaluation", S.with_ctes("", "pv", "sfx", "scored").rstrip() + "," + _LIVE_SRC + ", lv AS (SELECT * FROM "
          "live WHERE outcome = 'ok' AND p IS NOT NULL)," + _conf_sql("lv", "1", C.DEFAULT_THRESHOLD).replace("GROUP BY 1", "") + "," +
          _rank_sql("(SELECT 1 AS g, y, p FROM lv)", "g") + f"""
SELECT (SELECT count(*) FROM live WHERE outcome = 'skipped') AS skipped_no_snapshot,
       (SELECT count(*) FROM live WHERE outcome = 'failed' OR outcome = 'ok' AND p IS NULL) AS prediction_failures,
       cf.row_count AS total_evaluated, {_conf_cols('cf.')}, {r('rk.roc_auc')} AS roc_auc
FROM cf, rk""")
def live_evaluation(spark, sf_dir):
    """E6 + J7: closed SLA cases scored against actual outcome; skipped / failures counted (Q19)."""
    from docket.operators import interact as I

    from docket.operators.modeling import materialize

    return I.live_evaluation(materialize(_live(spark, sf_dir)), C.DEFAULT_THRESHOLD)  # ranking and counts read it


@register("evaluation_drift", S.with_ctes("", "pv", "sfx", "scored").rstrip() + "," + _LIVE_SRC + ", lv AS (SELECT * "
          "FROM live WHERE outcome = 'ok' AND p IS NOT NULL)," + _conf_sql("lv", "evaluated_at", C.DEFAULT_THRESHOLD) + f""",
e AS (SELECT evaluated_at, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, brier FROM cf),
d AS (SELECT evaluated_at, f1, brier, f1 - lag(f1) OVER (ORDER BY evaluated_at) AS f1_delta,
             brier - lag(brier) OVER (ORDER BY evaluated_at) AS brier_delta FROM e)
SELECT evaluated_at, {r('f1')} AS f1, {r('brier')} AS brier, {r('f1_delta')} AS f1_delta, {r('brier_delta')} AS brier_delta,
       CASE WHEN f1_delta IS NULL THEN NULL WHEN f1_delta > 0 THEN 'up' WHEN f1_delta < 0 THEN 'down'
            ELSE 'unchanged' END AS f1_direction,
       CASE WHEN brier_delta IS NULL THEN NULL WHEN brier_delta > 0 THEN 'up' WHEN brier_delta < 0 THEN 'down'
            ELSE 'unchanged' END AS brier_direction
FROM d""")
def evaluation_drift(spark, sf_dir):
    """One evaluation per completion year; delta/direction of F1 and Brier vs the previous one."""
    lv = _live(spark, sf_dir).where((F.col("outcome") == "ok") & F.col("p").isNotNull())
    ev = M.confusion(lv, ["evaluated_at"], C.DEFAULT_THRESHOLD).select("evaluated_at", "f1", "brier")
    return M.drift(ev).select("evaluated_at", "f1", "brier", "f1_delta", "brier_delta", "f1_direction",
                              "brier_direction")
