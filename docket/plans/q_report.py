"""Registered queries: dashboards, lists, detail, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket import config as C
from docket.operators import dataset as D
from docket.operators import report as RP
from docket.plans import sql as S
from docket.plans import views as V
from docket.plans.registry import r, register

AS_OF = C.TEST_AS_OF
CUT = f"TIMESTAMP '{(AS_OF - __import__('datetime').timedelta(days=C.DASHBOARD_DAYS)):%Y-%m-%d %H:%M:%S}'"
_OK = "status = 'success' AND prediction_context = 'opening'"


@register("prediction_view", S.with_ctes(f"""
SELECT id, process_id, model_bundle_id, prediction_context, status, {r('delay_probability')} AS delay_probability,
       CAST(risk_score AS BIGINT) AS risk_score, risk_level, CAST(predicted_is_delayed AS BIGINT) AS predicted_is_delayed,
       {r('predicted_hours')} AS predicted_hours, predicted_at
FROM preds2""", "preds2"))
def prediction_view(spark, sf_dir):
    """P17 risk score (half-even), P18 risk level, P19 decision on the events-derived prediction table."""
    return V.prediction_view(spark, sf_dir).select(
        "id", "process_id", "model_bundle_id", "prediction_context", "status", "delay_probability", "risk_score",
        "risk_level", "predicted_is_delayed", "predicted_hours", "predicted_at")


@register("prediction_kpis", S.with_ctes(f"""
SELECT count(*) AS total_predictions,
       CAST(coalesce(sum(CASE WHEN predicted_is_delayed = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_risk_count,
       {r('coalesce(avg(delay_probability), 0)')} AS avg_delay_probability,
       {r('coalesce(avg(predicted_hours), 0)')} AS avg_predicted_hours
FROM preds WHERE {_OK} AND predicted_at >= {CUT}""", "preds"))
def prediction_kpis(spark, sf_dir):
    """A2 over a 30-day window ending at the as-of time."""
    return RP.prediction_kpis(V.prediction_view(spark, sf_dir), AS_OF)


@register("prediction_kpis_bundle", S.with_ctes(f"""
SELECT count(*) AS total_predictions,
       CAST(coalesce(sum(CASE WHEN predicted_is_delayed = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_risk_count,
       {r('coalesce(avg(delay_probability), 0)')} AS avg_delay_probability,
       {r('coalesce(avg(predicted_hours), 0)')} AS avg_predicted_hours
FROM preds WHERE {_OK} AND predicted_at >= {CUT} AND model_bundle_id = 2""", "preds"))
def prediction_kpis_bundle(spark, sf_dir):
    """A2 restricted to one model bundle."""
    return RP.prediction_kpis(V.prediction_view(spark, sf_dir), AS_OF, bundle_id=2)


@register("daily_volume", S.with_ctes(f"""
SELECT strftime(CAST(predicted_at AS DATE), '%Y-%m-%d') AS day, count(*) AS count
FROM preds WHERE {_OK} AND predicted_at >= {CUT} GROUP BY 1""", "preds"))
def daily_volume(spark, sf_dir):
    """A4."""
    return RP.daily_volume(V.prediction_view(spark, sf_dir), AS_OF)


@register("process_type_distribution", S.with_ctes(f"""
SELECT coalesce(process_type, '{C.PROCESS_TYPE_NULL_LABEL}') AS process_type, count(*) AS count
FROM pv GROUP BY 1 ORDER BY count DESC, process_type ASC LIMIT {C.TOP_PROCESS_TYPES}""", "pv"))
def process_type_distribution(spark, sf_dir):
    """A5 (top-10 is the feature)."""
    return RP.process_type_distribution(V.process_view(spark, sf_dir))


@register("dashboard", S.with_ctes(f"""
SELECT 'prediction_kpis' AS section, metric, {r('value')} AS value FROM (
  SELECT CAST(count(*) AS DOUBLE) AS total_predictions,
         CAST(coalesce(sum(CASE WHEN predicted_is_delayed = 1 THEN 1 ELSE 0 END), 0) AS DOUBLE) AS high_risk_count,
         coalesce(avg(delay_probability), 0) AS avg_delay_probability,
         coalesce(avg(predicted_hours), 0) AS avg_predicted_hours
  FROM preds WHERE {_OK} AND predicted_at >= {CUT}) UNPIVOT (value FOR metric IN
    (total_predictions, high_risk_count, avg_delay_probability, avg_predicted_hours))
UNION ALL
SELECT 'actual_kpis' AS section, metric, {r('value')} AS value FROM (
  SELECT CAST(sum(CASE WHEN completed_at IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) AS total_completed,
         CAST(sum(CASE WHEN completed_at <= deadline THEN 1 ELSE 0 END) AS DOUBLE) AS on_time,
         CAST(sum(CASE WHEN completed_at > deadline THEN 1 ELSE 0 END) AS DOUBLE) AS actually_delayed,
         sum(CASE WHEN completed_at > deadline THEN 1 ELSE 0 END)
           / greatest(1, sum(CASE WHEN completed_at IS NOT NULL AND deadline IS NOT NULL THEN 1 ELSE 0 END))
           AS actual_delay_rate
  FROM pv) UNPIVOT (value FOR metric IN (total_completed, on_time, actually_delayed, actual_delay_rate))""",
                                     "preds", "pv"))
def dashboard(spark, sf_dir):
    """R2: A2 + A3 as one long KPI table."""
    return RP.dashboard_long(RP.prediction_kpis(V.prediction_view(spark, sf_dir), AS_OF),
                             D.actual_kpis(V.process_view(spark, sf_dir)))


_LATEST = f"""
SELECT process_id, id, predicted_at, {r('delay_probability')} AS delay_probability, CAST(risk_score AS BIGINT) AS risk_score,
       risk_level, CAST(predicted_is_delayed AS BIGINT) AS predicted_is_delayed, {r('predicted_hours')} AS predicted_hours
FROM (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY predicted_at DESC, id DESC) AS rn
      FROM preds2 WHERE {_OK} AND model_bundle_id = 1) t WHERE rn = 1"""


@register("latest_prediction", S.with_ctes(_LATEST, "preds2"))
def latest_prediction(spark, sf_dir):
    """W1 (bundle 1)."""
    return RP.latest_prediction(V.prediction_view(spark, sf_dir), bundle_id=1).select(
        "process_id", "id", "predicted_at", "delay_probability", "risk_score", "risk_level", "predicted_is_delayed",
        "predicted_hours")


@register("prediction_history", S.with_ctes(f"""
SELECT process_id, id, prediction_context, status, predicted_at, CAST(rank AS BIGINT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY predicted_at DESC, id DESC) AS rank FROM preds) t
WHERE rank <= {C.HISTORY_LIMIT}""", "preds"))
def prediction_history(spark, sf_dir):
    """Newest 50 per process, all contexts."""
    return RP.prediction_history(V.prediction_view(spark, sf_dir)).select(
        "process_id", "id", "prediction_context", "status", "predicted_at", "rank")


def _listing_sql(where: str) -> str:
    return f"""
lp AS ({_LATEST}),
lst AS (
  SELECT pv.external_id, pv.process_type, pv.current_status, pv.created_at, pv.completed_at, pv.deadline,
         lp.delay_probability, lp.risk_score, lp.risk_level, lp.predicted_is_delayed, lp.predicted_hours,
         CAST(CASE WHEN lp.delay_probability IS NOT NULL OR lp.predicted_hours IS NOT NULL THEN 1 ELSE 0 END AS BIGINT)
           AS has_prediction
  FROM pv LEFT JOIN lp ON pv.o_orderkey = lp.process_id
  WHERE {where})"""


_LIST_COLS = ["external_id", "process_type", "current_status", "created_at", "completed_at", "deadline",
              "delay_probability", "risk_score", "risk_level", "predicted_is_delayed", "predicted_hours",
              "has_prediction"]


def _listing(spark, sf_dir, status, risk):
    return RP.process_with_prediction(V.process_view(spark, sf_dir), V.prediction_view(spark, sf_dir), 1, status,
                                      risk).select(*_LIST_COLS)


@register("process_list_page", S.with_ctes("", "pv", "preds2").rstrip() + "," + _listing_sql(
    "pv.completed_at IS NOT NULL") + """
SELECT * FROM lst ORDER BY created_at DESC, external_id ASC LIMIT 20 OFFSET 20""")
def process_list_page(spark, sf_dir):
    """W3 + J2 + F7: closed processes, page 2 of 20, with latest bundle-1 prediction."""
    return RP.process_page(_listing(spark, sf_dir, "closed", None), page=2, per_page=20)


@register("process_list_risk", S.with_ctes("", "pv", "preds2").rstrip() + "," + _listing_sql(
    "lp.predicted_is_delayed IS NOT NULL AND lp.predicted_is_delayed <> 1") + """
SELECT * FROM lst""")
def process_list_risk(spark, sf_dir):
    """F8 low-risk filter over the whole joined list."""
    return _listing(spark, sf_dir, None, "low_risk")


@register("process_list_totals", S.with_ctes("", "pv", "preds2").rstrip() + "," + _listing_sql(
    "pv.completed_at IS NULL AND lp.predicted_is_delayed = 1") + """
SELECT count(*) AS total FROM lst""")
def process_list_totals(spark, sf_dir):
    """F7 open + F8 high-risk: total for the pager."""
    return _listing(spark, sf_dir, "open", "high_risk").agg(F.count(F.lit(1)).alias("total"))


@register("process_detail", S.with_ctes(f"""
SELECT pv.external_id, pv.process_type, pv.current_status, pv.completed_at, pv.deadline, pv.closure_reason,
       CASE WHEN pv.completed_at IS NOT NULL THEN round(greatest({S.hours_sql('pv.created_at', 'pv.completed_at')}, 0), 2)
       END AS total_duration_hours,
       CAST(CASE WHEN pv.deadline IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS has_sla,
       d.open_month, d.open_weekday, d.open_hour, d.is_weekend, {r('d.sla_duration_hours')} AS sla_duration_hours,
       d.source, d.reason,
       lp.id AS prediction_id, {r('lp.delay_probability')} AS delay_probability, CAST(lp.risk_score AS BIGINT) AS risk_score,
       lp.risk_level
FROM pv LEFT JOIN sfx d ON pv.external_id = d.external_id
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY predicted_at DESC, id DESC) rn
           FROM preds2 WHERE {_OK}) WHERE rn = 1) lp ON pv.o_orderkey = lp.process_id""", "pv", "sfx", "preds2"))
def process_detail(spark, sf_dir):
    """R1 + P22: opening features (from the snapshot) vs current fields vs latest prediction."""
    pv = V.process_view(spark, sf_dir)
    feats = D.scoring_features(V.snapshot_view(spark, sf_dir)).select(
        "external_id", "open_month", "open_weekday", "open_hour", "is_weekend", "sla_duration_hours", "source", "reason")
    out = RP.process_detail(pv, feats, V.prediction_view(spark, sf_dir))
    return out.select(
        "external_id", "process_type", "current_status", "completed_at", "deadline", "closure_reason",
        "total_duration_hours", "has_sla", "open_month", "open_weekday", "open_hour", "is_weekend",
        "sla_duration_hours", "source", "reason", "prediction_id", "delay_probability", "risk_score", "risk_level")
