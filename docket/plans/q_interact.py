"""Registered queries: options, feedback, what-if, batch scoring plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket import config as C
from docket.operators import dataset as D
from docket.operators import interact as I
from docket.plans import sql as S
from docket.plans import views as V
from docket.plans.registry import r, register
from docket.session import read_table

# ------------------------------------------------------------------ fixtures (Spark)


def _feedback_requests(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("request_id"),
        (F.col("event_id") - F.col("event_id") % 4).alias("prediction_id"),
        F.when(et.isin("click", "signup"), "accuracy").when(et.isin("view", "purchase"), "usefulness")
        .otherwise("bogus").alias("feedback_type"),
        F.when(F.col("user_id") % 5 == 0, F.lit("   "))
        .when((F.col("user_id") % 11 == 0) & (et == "view"), F.repeat(F.lit("x"), 5001))
        .otherwise(F.col("props")).alias("comment"),
        F.col("ts").alias("created_at"))


def _processes(spark, sf_dir):
    return V.process_view(spark, sf_dir).select(F.col("o_orderkey").alias("process_id"), "deadline", "completed_at")


def _scenarios(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    u, v = F.col("user_id"), F.col("value")
    return ev.select(
        F.col("event_id").alias("scenario_id"), F.col("event_id").alias("base_prediction_id"),
        u.alias("process_id"),
        F.when(u % 3 == 0, "asia").when(u % 3 == 1, "atlantis").alias("source"),
        *[F.lit(None).cast("string").alias(c) for c in ("subject", "reason", "type", "neighborhood")],
        F.lit(None).cast("int").alias("open_month"),
        F.when(v > 400, F.lit(9)).cast("int").alias("open_weekday"),
        F.when(u % 13 != 0, F.hour("ts")).cast("int").alias("open_hour"),
        F.lit(None).cast("int").alias("is_weekend"),
        F.when(u % 13 == 0, F.lit(None)).when(v > 480, v * 200).otherwise(v * 10).cast("double").alias(
            "sla_duration_hours"))


def _features(spark, sf_dir):
    # only snapshots of requested cases are parsed
    asked = read_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("external_id")).distinct()
    feats = D.scoring_features(V.snapshot_view(spark, sf_dir).join(asked, "external_id", "left_semi"))
    return feats.where(F.col("feature_error").isNull()).select(F.col("external_id").cast("long").alias("process_id"),
                                                                 *C.ALL_FEATURES)


def _snapshots_fp(spark, sf_dir):
    s = V.snapshot_view(spark, sf_dir).where(F.col("snapshot_type") == C.SNAPSHOT_TYPE)
    return s.select(F.col("external_id").cast("long").alias("process_id"),
                    F.col("external_id").cast("long").alias("snapshot_id"),
                    F.sha2("input_json", 256).alias("input_fingerprint"))


def _prior(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    snaps = _snapshots_fp(spark, sf_dir).select(F.col("process_id").alias("user_id"),
                                                F.col("input_fingerprint").alias("_fp"))
    et = F.col("event_type")
    return ev.join(snaps.hint("merge"), "user_id", "left").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("snapshot_id"),
        F.when(et.isin("click", "view"), F.col("_fp")).otherwise(F.lit("stale")).alias("input_fingerprint"),
        F.when(et == "signup", 2).otherwise(1).alias("model_bundle_id"),
        F.when(et == "purchase", "simulation").otherwise("opening").alias("prediction_context"),
        F.when(et == "error", "failed").otherwise("success").alias("status"))


def _requests(spark, sf_dir):
    pv = V.process_view(spark, sf_dir).select("o_orderkey")
    copies = F.when(F.col("o_orderkey") % 61 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return pv.select(F.col("o_orderkey").alias("process_id"), F.explode(copies).alias("_c")).drop("_c")


# ------------------------------------------------------------------ SQL twins
_FB_SQL = """
fr AS (SELECT event_id AS request_id, event_id - event_id % 4 AS prediction_id,
              CASE WHEN event_type IN ('click', 'signup') THEN 'accuracy'
                   WHEN event_type IN ('view', 'purchase') THEN 'usefulness' ELSE 'bogus' END AS feedback_type,
              CASE WHEN user_id % 5 = 0 THEN '   ' WHEN user_id % 11 = 0 AND event_type = 'view' THEN repeat('x', 5001)
                   ELSE props END AS comment, ts AS created_at FROM events),
fv AS (SELECT fr.*, nullif(trim(comment), '') AS comment_clean, p.process_id, p.prediction_context,
              CASE WHEN feedback_type NOT IN ('accuracy', 'usefulness') THEN 'INVALID_FEEDBACK_TYPE'
                   WHEN length(comment) > 5000 THEN 'COMMENT_TOO_LONG'
                   WHEN feedback_type = 'usefulness' AND nullif(trim(comment), '') IS NULL THEN 'COMMENT_REQUIRED'
                   WHEN p.prediction_context IS NULL THEN 'PREDICTION_NOT_FOUND'
                   WHEN p.prediction_context = 'simulation' THEN 'FEEDBACK_NOT_ALLOWED' END AS reject_code
       FROM fr LEFT JOIN preds p ON fr.prediction_id = p.id)"""


@register("simulation_options", """
SELECT 'source' AS "column", code FROM (SELECT DISTINCT """ + S.code_sql("r_name") + """ AS code FROM region)
UNION SELECT 'subject', """ + S.code_sql("c_mktsegment") + """ FROM customer
UNION SELECT 'reason', """ + S.code_sql("o_orderpriority") + """ FROM orders
UNION SELECT 'type', """ + S.code_sql("p_brand") + """ FROM part
UNION SELECT 'neighborhood', """ + S.code_sql("n_name") + """ FROM nation
UNION SELECT c, x FROM (SELECT unnest(['source', 'subject', 'reason', 'type', 'neighborhood']) AS c),
                       (SELECT unnest(['missing', 'unknown']) AS x)""")
def simulation_options(spark, sf_dir):
    """Allowed what-if codes per feature (catalog codes + missing + unknown)."""
    return I.known_values(V.catalog_view(spark, sf_dir))


@register("feedback_state", S.with_ctes("", "preds", "pv").rstrip() + "," + _FB_SQL + """
SELECT prediction_id, feedback_type, comment, actual_outcome, created_at FROM (
  SELECT fv.prediction_id, fv.feedback_type, fv.comment_clean AS comment,
         CAST(CASE WHEN fv.feedback_type = 'accuracy' AND pv.deadline IS NOT NULL AND pv.completed_at IS NOT NULL
                   THEN CASE WHEN pv.completed_at > pv.deadline THEN 1 ELSE 0 END END AS BIGINT) AS actual_outcome,
         fv.created_at,
         row_number() OVER (PARTITION BY fv.prediction_id, fv.feedback_type
                            ORDER BY fv.created_at DESC, fv.request_id DESC) AS rk
  FROM fv LEFT JOIN pv ON fv.process_id = pv.o_orderkey WHERE fv.reject_code IS NULL) t WHERE rk = 1""")
def feedback_state(spark, sf_dir):
    """W6 + J6 + P26: latest feedback per (prediction, type) with the derived actual outcome."""
    out = I.feedback_upsert(_feedback_requests(spark, sf_dir), V.prediction_view(spark, sf_dir),
                            _processes(spark, sf_dir))
    return out["state"]


@register("feedback_rejects", S.with_ctes("", "preds").rstrip() + "," + _FB_SQL + """
SELECT request_id, prediction_id, reject_code FROM fv WHERE reject_code IS NOT NULL""")
def feedback_rejects(spark, sf_dir):
    """P26 + W6: refused submissions with their reason."""
    out = I.feedback_upsert(_feedback_requests(spark, sf_dir), V.prediction_view(spark, sf_dir),
                            _processes(spark, sf_dir))
    return out["rejects"]


_SC_SQL = """
sc AS (SELECT event_id AS scenario_id, event_id AS base_prediction_id, user_id AS process_id,
              CASE WHEN user_id % 3 = 0 THEN 'asia' WHEN user_id % 3 = 1 THEN 'atlantis' END AS source,
              CASE WHEN value > 400 THEN 9 END AS open_weekday,
              CASE WHEN user_id % 13 <> 0 THEN hour(ts) END AS open_hour,
              CASE WHEN user_id % 13 = 0 THEN NULL WHEN value > 480 THEN value * 200 ELSE value * 10 END
                AS sla_duration_hours
       FROM events),
opt AS (SELECT DISTINCT """ + S.code_sql("r_name") + """ AS code FROM region UNION SELECT 'missing' UNION SELECT 'unknown'),
scv AS (SELECT sc.*,
          CASE WHEN source IS NULL AND open_weekday IS NULL AND open_hour IS NULL AND sla_duration_hours IS NULL
               THEN 'NO_OVERRIDE'
               WHEN (open_weekday IS NOT NULL AND open_weekday NOT BETWEEN 0 AND 6)
                 OR (open_hour IS NOT NULL AND open_hour NOT BETWEEN 0 AND 23)
                 OR (sla_duration_hours IS NOT NULL AND sla_duration_hours NOT BETWEEN 0 AND 87600)
               THEN 'OVERRIDE_OUT_OF_RANGE'
               WHEN source IS NOT NULL AND source NOT IN (SELECT code FROM opt) THEN 'OVERRIDE_NOT_ALLOWED' END AS rc
        FROM sc),
fe AS (SELECT CAST(external_id AS BIGINT) AS process_id, * EXCLUDE (external_id) FROM sfx WHERE feature_error = 0),
bp AS (SELECT id, process_id AS bp_process, model_bundle_id FROM preds
       WHERE status = 'success' AND prediction_context = 'opening'),
scm AS (SELECT scv.*, bp.model_bundle_id, fe.process_id IS NOT NULL AS has_snap,
           coalesce(scv.rc, CASE WHEN bp.id IS NULL OR bp.bp_process <> scv.process_id THEN 'BASE_PREDICTION_NOT_FOUND'
                                 WHEN fe.process_id IS NULL THEN 'SNAPSHOT_NOT_FOUND' END) AS reject_code,
           coalesce(scv.source, fe.source) AS m_source, fe.subject, fe.reason, fe.type, fe.neighborhood,
           fe.open_month, coalesce(scv.open_weekday, fe.open_weekday) AS m_open_weekday,
           coalesce(scv.open_hour, fe.open_hour) AS m_open_hour, fe.is_weekend,
           coalesce(scv.sla_duration_hours, fe.sla_duration_hours) AS m_sla
        FROM scv LEFT JOIN bp ON scv.base_prediction_id = bp.id LEFT JOIN fe ON scv.process_id = fe.process_id)"""


@register("whatif_scenarios", S.with_ctes("", "preds", "sfx").rstrip() + "," + _SC_SQL + f"""
SELECT scenario_id, process_id, base_prediction_id, model_bundle_id, m_source AS source, subject, reason, type,
       neighborhood, open_month, CAST(m_open_weekday AS BIGINT) AS open_weekday, CAST(m_open_hour AS BIGINT) AS open_hour,
       is_weekend, {r('m_sla')} AS sla_duration_hours,
       CAST(CASE WHEN m_sla IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS has_sla, 'simulation' AS prediction_context
FROM scm WHERE reject_code IS NULL""")
def whatif_scenarios(spark, sf_dir):
    """P27 + J9 + X7: valid scenarios merged over the opening features."""
    opts = I.known_values(V.catalog_view(spark, sf_dir))
    checked = I.override_rules(_scenarios(spark, sf_dir), opts)
    out = I.scenario_merge(checked, V.prediction_view(spark, sf_dir), _features(spark, sf_dir))
    return out["merged"]


@register("whatif_rejects", S.with_ctes("", "preds", "sfx").rstrip() + "," + _SC_SQL + """
SELECT scenario_id, process_id, reject_code FROM scm WHERE reject_code IS NOT NULL""")
def whatif_rejects(spark, sf_dir):
    """P27 + J9: refused scenarios with the first failing rule."""
    opts = I.known_values(V.catalog_view(spark, sf_dir))
    checked = I.override_rules(_scenarios(spark, sf_dir), opts)
    return I.scenario_merge(checked, V.prediction_view(spark, sf_dir), _features(spark, sf_dir))["rejects"]


_SNAP_JSON = ("'{\"created_at\":' || coalesce(to_json(" + S.iso_sql("created_at") + "), 'null') || "
              "',\"deadline\":' || coalesce(to_json(" + S.iso_sql("deadline") + "), 'null') || "
              "',\"external_id\":' || to_json(external_id) || ',\"source\":' || to_json(source) || "
              "',\"subject\":' || to_json(subject) || ',\"reason\":' || to_json(reason) || ',\"type\":' || to_json(type)")
_PLAN_SQL = f"""
sn AS (SELECT o_orderkey AS process_id, o_orderkey AS snapshot_id,
              sha256(CASE WHEN o_orderkey % 97 = 13 THEN {_SNAP_JSON} || '}}'
                          WHEN o_orderkey % 89 = 7 THEN '{{bad json'
                          ELSE {_SNAP_JSON} || ',"neighborhood":' || to_json(neighborhood) || '}}' END) AS input_fingerprint
       FROM pv),
pr AS (SELECT e.event_id AS id, e.user_id AS snapshot_id,
              CASE WHEN e.event_type IN ('click', 'view') THEN sn.input_fingerprint ELSE 'stale' END AS input_fingerprint
       FROM events e LEFT JOIN sn ON e.user_id = sn.process_id
       WHERE e.event_type NOT IN ('signup', 'purchase', 'error')),
rq AS (SELECT o_orderkey AS process_id FROM pv UNION ALL SELECT o_orderkey FROM pv WHERE o_orderkey % 61 = 0),
rc AS (SELECT process_id, count(*) AS n FROM rq GROUP BY 1),
plan AS (
  SELECT rq.process_id,
         CASE WHEN rq.process_id <= 0 OR rc.n > 1 THEN 'rejected' WHEN sn.snapshot_id IS NULL THEN 'failed'
              WHEN ru.rid IS NOT NULL THEN 'reuse' ELSE 'score' END AS action,
         CASE WHEN rq.process_id <= 0 THEN 'NON_POSITIVE_ID' WHEN rc.n > 1 THEN 'DUPLICATE_ID'
              WHEN sn.snapshot_id IS NULL THEN 'SNAPSHOT_NOT_FOUND' END AS error_code,
         CASE WHEN rq.process_id <= 0 OR rc.n > 1 THEN NULL ELSE ru.rid END AS reused_prediction_id
  FROM rq JOIN rc ON rq.process_id = rc.process_id
  LEFT JOIN sn ON rq.process_id = sn.process_id
  LEFT JOIN (SELECT snapshot_id, input_fingerprint, max(id) AS rid FROM pr GROUP BY 1, 2) ru
    ON sn.snapshot_id = ru.snapshot_id AND sn.input_fingerprint = ru.input_fingerprint)"""


def _plan(spark, sf_dir):
    return I.reuse_plan(_requests(spark, sf_dir), _snapshots_fp(spark, sf_dir), _prior(spark, sf_dir), bundle_id=1)


@register("scoring_plan", S.with_ctes("", "pv").rstrip() + "," + _PLAN_SQL + """
SELECT process_id, action, error_code, reused_prediction_id FROM plan""")
def scoring_plan(spark, sf_dir):
    """F10 + J8 + W7: per requested id - rejected, failed, reuse of a prior success, or score."""
    return _plan(spark, sf_dir)


@register("batch_outcome_counts", S.with_ctes("", "pv").rstrip() + "," + _PLAN_SQL + """
SELECT CAST(sum(CASE WHEN action IN ('score', 'reuse') THEN 1 ELSE 0 END) AS BIGINT) AS succeeded,
       CAST(sum(CASE WHEN action NOT IN ('score', 'reuse') THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM plan""")
def batch_outcome_counts(spark, sf_dir):
    """A19."""
    return I.batch_outcome_counts(_plan(spark, sf_dir))
