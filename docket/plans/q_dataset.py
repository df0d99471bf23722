"""Registered queries: targets, features, dataset, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket import config as C
from docket.operators import dataset as D
from docket.plans import sql as S
from docket.plans import views as V
from docket.plans.registry import r, register

_FEATS = ", ".join(C.CATEGORICAL_FEATURES + ["open_month", "open_weekday", "open_hour", "is_weekend"])


def _dataset(spark, sf_dir):
    return D.build_dataset(V.snapshot_view(spark, sf_dir), V.process_view(spark, sf_dir), C.TEST_SPLITS, C.TEST_CUTOFF)


@register("case_derivation", S.with_ctes("""
SELECT o_orderkey, external_id, created_at, deadline, completed_at,
       CASE WHEN completed_at IS NULL THEN 'Open' ELSE 'Closed' END AS current_status,
       CASE WHEN completed_at IS NULL THEN NULL WHEN o_orderstatus = 'F' THEN 'Case Resolved' ELSE 'Case Noted' END AS closure_reason,
       source, subject, reason, type, neighborhood, department FROM praw""", "praw"))
def case_derivation(spark, sf_dir):
    """The case table itself, derived anew from orders and line items (all other queries read its stored copy)."""
    return V._process_raw(spark, sf_dir)


@register("case_targets", S.with_ctes(f"""
SELECT external_id, created_at, deadline, completed_at, open_month, open_weekday, open_hour, is_weekend,
       {r('sla_duration_hours')} AS sla_duration_hours, CAST(is_delayed AS BIGINT) AS is_delayed,
       {r('total_duration_hours')} AS total_duration_hours, split
FROM pt""", "pt"))
def case_targets(spark, sf_dir):
    """P11, P12, P14, P15, P16 over the whole process table."""
    t = D.case_targets(V.process_view(spark, sf_dir), C.TEST_SPLITS, C.TEST_CUTOFF)
    return t.select("external_id", "created_at", "deadline", "completed_at", "open_month", "open_weekday",
                    "open_hour", "is_weekend", "sla_duration_hours", "is_delayed", "total_duration_hours", "split")


@register("dataset_rows", S.with_ctes(f"""
SELECT external_id, created_at, split, {_FEATS}, {r('sla_duration_hours')} AS sla_duration_hours,
       CAST(is_delayed AS BIGINT) AS is_delayed, {r('total_duration_hours')} AS total_duration_hours, schema_error
FROM dsx""", "dsx"))
def dataset_rows(spark, sf_dir):
    """F6 + J1 + P10 (JSON parse, required keys) + P11-P16 from the opening snapshot."""
    ds = _dataset(spark, sf_dir)
    return ds.withColumn("schema_error", F.col("schema_error").isNotNull().cast("bigint"))


@register("classification_cohort", S.with_ctes(f"""
SELECT external_id, split, {_FEATS}, {r('sla_duration_hours')} AS sla_duration_hours,
       CAST(is_delayed AS BIGINT) AS is_delayed
FROM dsx WHERE schema_error = 0 AND is_delayed IS NOT NULL AND split IS NOT NULL""", "dsx"))
def classification_cohort(spark, sf_dir):
    """F5 classification cohort."""
    return D.cohort(_dataset(spark, sf_dir), "is_delayed").select("external_id", "split", *C.ALL_FEATURES, "is_delayed")


@register("regression_cohort", S.with_ctes(f"""
SELECT external_id, split, {_FEATS}, {r('sla_duration_hours')} AS sla_duration_hours,
       {r('total_duration_hours')} AS total_duration_hours
FROM dsx WHERE schema_error = 0 AND total_duration_hours IS NOT NULL AND split IS NOT NULL""", "dsx"))
def regression_cohort(spark, sf_dir):
    """F5 regression cohort."""
    return D.cohort(_dataset(spark, sf_dir), "total_duration_hours").select(
        "external_id", "split", *C.ALL_FEATURES, "total_duration_hours")


@register("split_summary", S.with_ctes("""
SELECT cohort, split, CAST(CASE WHEN split IN ('test', 'audit') THEN 1 ELSE 0 END AS BIGINT) AS sealed,
       count(*) AS row_count, min(created_at) AS min_created_at, max(created_at) AS max_created_at
FROM (SELECT 'classification' AS cohort, * FROM dsx WHERE schema_error = 0 AND is_delayed IS NOT NULL
      UNION ALL
      SELECT 'regression' AS cohort, * FROM dsx WHERE schema_error = 0 AND total_duration_hours IS NOT NULL) t
WHERE split IS NOT NULL
GROUP BY cohort, split""", "dsx"))
def split_summary(spark, sf_dir):
    """Counts and date range per cohort and split."""
    return D.split_summary(_dataset(spark, sf_dir))


@register("build_accounting", S.with_ctes("""
SELECT count(*) AS total_snapshots,
       CAST(sum(CASE WHEN schema_error = 0 AND is_delayed IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS classification_excluded,
       CAST(sum(CASE WHEN schema_error = 0 AND total_duration_hours IS NULL THEN 1 ELSE 0 END) AS BIGINT)
         AS regression_excluded,
       CAST(sum(CASE WHEN schema_error = 0 AND split IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unassigned_split,
       CAST(sum(schema_error) AS BIGINT) AS schema_errors
FROM dsx""", "dsx"))
def build_accounting(spark, sf_dir):
    """A16."""
    snaps = V.snapshot_view(spark, sf_dir)
    return D.build_accounting(snaps, _dataset(spark, sf_dir))


@register("actual_kpis", S.with_ctes(f"""
SELECT CAST(coalesce(sum(CASE WHEN completed_at IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS total_completed,
       CAST(coalesce(sum(CASE WHEN completed_at IS NOT NULL AND deadline IS NOT NULL AND completed_at <= deadline
                              THEN 1 ELSE 0 END), 0) AS BIGINT) AS on_time,
       CAST(coalesce(sum(CASE WHEN completed_at IS NOT NULL AND deadline IS NOT NULL AND completed_at > deadline
                              THEN 1 ELSE 0 END), 0) AS BIGINT) AS actually_delayed,
       {r('''coalesce(sum(CASE WHEN completed_at IS NOT NULL AND deadline IS NOT NULL AND completed_at > deadline
                         THEN 1 ELSE 0 END), 0) / greatest(1, coalesce(sum(CASE WHEN completed_at IS NOT NULL
                         AND deadline IS NOT NULL THEN 1 ELSE 0 END), 0))''')} AS actual_delay_rate
FROM pv""", "pv"))
def actual_kpis(spark, sf_dir):
    """A3 over all processes."""
    return D.actual_kpis(V.process_view(spark, sf_dir))


def _fingerprint_sql(target):
    def text(c):
        t = f"CAST(round({c} * 3.6e9) AS BIGINT)" if c in ("sla_duration_hours", "total_duration_hours") else c
        t = f"CAST({t} AS VARCHAR)"
        return f"coalesce(length({t}) || ':' || {t}, '-')"

    row = " || ".join(text(c) for c in ["external_id", *C.ALL_FEATURES, target])
    meta = "|".join([C.FEATURE_SCHEMA_VERSION, C.CANONICAL_MAPPING_VERSION, C.TEST_CUTOFF.isoformat(), ",".join(C.ALL_FEATURES), target])
    return f"""
SELECT '{target}' AS target, count(*) AS row_count,
       sha256('{meta}|' || count(*) || '|' || coalesce(CAST(sum(CAST('0x' || substr(sha256({row}), 1, 15) AS BIGINT)) AS VARCHAR), '0'))
         AS fingerprint
FROM dsx WHERE schema_error = 0 AND {target} IS NOT NULL AND split IS NOT NULL"""


@register("dataset_fingerprint", S.with_ctes(_fingerprint_sql("is_delayed") + "\nUNION ALL" + _fingerprint_sql("total_duration_hours"), "dsx"))
def dataset_fingerprint(spark, sf_dir):
    """A17 for both cohorts."""
    from docket.operators.modeling import materialize

    ds = materialize(_dataset(spark, sf_dir))  # both cohorts read it
    return D.dataset_fingerprint(ds, "is_delayed", C.TEST_CUTOFF).unionByName(
        D.dataset_fingerprint(ds, "total_duration_hours", C.TEST_CUTOFF))
