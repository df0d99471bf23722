"""Registered queries: profiling, cleaning, scans, constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket import config as C
from docket.functions import exprs as X
from docket.operators import dataset as D
from docket.operators import quality as Q
from docket.plans import sql as S
from docket.plans import views as V
from docket.plans.registry import r, register
from docket.session import read_table

_CAT = ["process_type", "current_status", "closure_reason"]


def _unpivot_sql(cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM pv" for c in cols)


@register("categorical_profile", S.with_ctes(f"""
SELECT column_name AS "column",
       CAST(sum(CASE WHEN value IS NULL OR trim(value) = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       {r("round(sum(CASE WHEN value IS NULL OR trim(value) = '' THEN 1 ELSE 0 END) / count(*) * 100, 2)")} AS missing_pct,
       count(DISTINCT CASE WHEN NOT (value IS NULL OR trim(value) = '') THEN value END) AS "unique"
FROM ({_unpivot_sql(_CAT)}) t GROUP BY column_name""", "pv"))
def categorical_profile(spark, sf_dir):
    """A8 summary over the process table."""
    return Q.categorical_profile(V.process_view(spark, sf_dir), _CAT)


@register("categorical_top5", S.with_ctes(f"""
SELECT column_name AS "column", value, count, CAST(rank AS BIGINT) AS rank FROM (
  SELECT column_name, value, count(*) AS count,
         row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value ASC) AS rank
  FROM ({_unpivot_sql(_CAT)}) t WHERE value IS NOT NULL AND trim(value) <> ''
  GROUP BY column_name, value) x WHERE rank <= 5""", "pv"))
def categorical_top5(spark, sf_dir):
    """A8 top-5 values per column."""
    return Q.categorical_top(V.process_view(spark, sf_dir), _CAT, 5)


_DUR = "pt"


@register("numeric_profile", S.with_ctes(f"""
SELECT count(total_duration_hours) AS count,
       count(*) - count(total_duration_hours) AS missing,
       {r('min(total_duration_hours)')} AS min, {r('max(total_duration_hours)')} AS max,
       {r('avg(total_duration_hours)')} AS mean, {r('quantile_cont(total_duration_hours, 0.5)')} AS median,
       {r('stddev_pop(total_duration_hours)')} AS std,
       {r('quantile_cont(total_duration_hours, 0.25)')} AS q1, {r('quantile_cont(total_duration_hours, 0.75)')} AS q3,
       {r('quantile_cont(total_duration_hours, 0.75) - quantile_cont(total_duration_hours, 0.25)')} AS iqr,
       (SELECT count(*) FROM pt, (SELECT quantile_cont(total_duration_hours, 0.25) AS a,
                                          quantile_cont(total_duration_hours, 0.75) AS b FROM pt) q
        WHERE total_duration_hours < a - 1.5 * (b - a) OR total_duration_hours > b + 1.5 * (b - a)) AS outliers_iqr
FROM pt""", "pt"))
def numeric_profile(spark, sf_dir):
    """A9 on non-negative durations; missing counted against all processes."""
    t = D.case_targets(V.process_view(spark, sf_dir), C.TEST_SPLITS, C.TEST_CUTOFF)
    return Q.numeric_profile(t, "total_duration_hours").select(
        "count", "missing", "min", "max", "mean", "median", "std", "q1", "q3", "iqr", "outliers_iqr")


@register("snapshot_type_counts", S.with_ctes("""
SELECT 'opening' AS snapshot_type,
       CASE WHEN o_orderkey % 83 = 5 THEN 'opening-v0' ELSE 'opening-v1' END AS feature_schema_version,
       count(*) AS count,
       CAST(sum(CASE WHEN external_id IS NULL OR trim(external_id) = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing_external_id
FROM pv GROUP BY 1, 2""", "pv"))
def snapshot_type_counts(spark, sf_dir):
    """Snapshots by type and schema version, plus missing external ids."""
    s = V.snapshot_view(spark, sf_dir)
    return s.groupBy("snapshot_type", "feature_schema_version").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.when(F.col("external_id").isNull() | (F.trim("external_id") == ""), 1).otherwise(0)).cast("bigint")
        .alias("missing_external_id"))


def _closed(spark, sf_dir):
    pv = V.process_view(spark, sf_dir)
    return pv.where(F.col("completed_at").isNotNull()).select(
        "o_orderkey", "external_id", "created_at", "completed_at",
        X.hours_between("created_at", "completed_at").alias("duration_hours"))


_CLOSED_SQL = f"""
cl AS (SELECT o_orderkey, external_id, created_at, completed_at, {S.hours_sql('created_at', 'completed_at')} AS d
       FROM pv WHERE completed_at IS NOT NULL),
v AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM cl WHERE d >= 0),
b AS (SELECT max(n) AS n,
             CASE WHEN max(n) < 4 THEN 0 ELSE max(CASE WHEN i = floor(n * 0.25) THEN d END) END AS q1,
             CASE WHEN max(n) < 4 THEN 0 ELSE max(CASE WHEN i = floor(n * 0.75) THEN d END) END AS q3 FROM v),
bb AS (SELECT n, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b)"""


@register("cleaning_report", S.with_ctes("", "pv").rstrip() + "," + _CLOSED_SQL + f"""
SELECT (SELECT count(*) FROM cl) AS total_completed,
       (SELECT count(*) FROM cl WHERE d >= 0) AS valid_durations,
       (SELECT count(*) FROM cl WHERE d < 0) AS negative_duration_count,
       {r('round(q1, 2)')} AS q1, {r('round(q3, 2)')} AS q3, {r('round(lower, 2)')} AS lower, {r('round(upper, 2)')} AS upper,
       (SELECT count(*) FROM cl WHERE d >= 0 AND lower > 0 AND d < lower) AS outliers_below_lower,
       (SELECT count(*) FROM cl WHERE d >= 0 AND d > upper) AS outliers_above_upper,
       {r('round((SELECT count(*) FROM cl WHERE d >= 0 AND d > upper) / n * 100, 1)')} AS outliers_above_pct
FROM bb""")
def cleaning_report(spark, sf_dir):
    """Negatives and index-quantile IQR bounds over completed cases."""
    return Q.cleaning_report(_closed(spark, sf_dir))


@register("negative_duration_samples", S.with_ctes("", "pv").rstrip() + "," + _CLOSED_SQL + f"""
SELECT external_id, created_at, completed_at, {r('round(d, 2)')} AS duration_hours
FROM cl WHERE d < 0 ORDER BY o_orderkey LIMIT 10""")
def negative_duration_samples(spark, sf_dir):
    """A12 sample: first 10 negative-duration cases by id (a top-k report)."""
    return Q.negative_samples(_closed(spark, sf_dir), "o_orderkey").select(
        "external_id", "created_at", "completed_at", "duration_hours")


@register("winsorized_durations", S.with_ctes("", "pv").rstrip() + "," + _CLOSED_SQL + f"""
SELECT external_id, {r('d')} AS duration_hours, {r('least(greatest(d, lower), upper)')} AS duration_hours_capped
FROM cl, bb WHERE d >= 0""")
def winsorized_durations(spark, sf_dir):
    """Durations clamped to the A12 bounds (the cap is opt-in; enabled here)."""
    valid = _closed(spark, sf_dir).where(F.col("duration_hours") >= 0)
    bounds = Q.index_quantile_bounds(valid, "duration_hours")
    return Q.winsorize(valid, "duration_hours", bounds).select("external_id", "duration_hours",
                                                               "duration_hours_capped")


@register("invalid_year_counts", S.with_ctes(f"""
SELECT CAST(year(created_at) AS BIGINT) AS year, count(*) AS rows,
       CAST(sum(CASE WHEN year(created_at) NOT BETWEEN {C.CLEANING_MIN_YEAR} AND {C.CLEANING_MAX_YEAR}
                     THEN 1 ELSE 0 END) AS BIGINT) AS invalid_year
FROM pv GROUP BY 1""", "pv"))
def invalid_year_counts(spark, sf_dir):
    """The configured year rule, flagged and counted (never enforced)."""
    f = Q.invalid_year_flags(V.process_view(spark, sf_dir), "created_at")
    return f.groupBy(F.year("created_at").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("invalid_year").cast("bigint").alias("invalid_year"))


# Oracle twins of the sensitive patterns (RE2).  The base64 rule's look-around
# is implied by maximal runs of the class, so the plain run pattern is equal.
_PAT_SQL = [
    ("api_key", r"""(?i)api[_-]?key\s*[=:]\s*["'][^"']+["']"""),
    ("password", r"""(?i)password\s*[=:]\s*["'][^"']+["']"""),
    ("token", r"""(?i)token\s*[=:]\s*["'][^"']{20,}["']"""),
    ("secret", r"""(?i)secret\s*[=:]\s*["'][^"']+["']"""),
    ("base64_like", r"""[a-zA-Z0-9+/]{40,}"""),
]


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SCAN = "sc AS (SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all(text, {_sql_str(p)})) AS BIGINT) AS {n}" for n, p in _PAT_SQL) + " FROM documents)"


@register("sensitive_scan_totals", f"WITH {_SCAN}\n" + " UNION ALL ".join(
    f"SELECT '{n}' AS pattern, CAST(sum(CASE WHEN {n} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_with_hits, "
    f"CAST(sum({n}) AS BIGINT) AS total_hits FROM sc" for n, _ in _PAT_SQL))
def sensitive_scan_totals(spark, sf_dir):
    """hits per pattern over all documents."""
    scan = Q.pattern_scan(read_table(spark, sf_dir, "documents"), "text", "doc_id")
    return Q.pattern_totals(scan, [n for n, _ in C.SENSITIVE_PATTERNS])


@register("sensitive_scan_rows", f"WITH {_SCAN}\nSELECT * FROM sc WHERE " + " + ".join(n for n, _ in _PAT_SQL) + " > 0")
def sensitive_scan_rows(spark, sf_dir):
    """documents with at least one hit, per-pattern counts."""
    scan = Q.pattern_scan(read_table(spark, sf_dir, "documents"), "text", "doc_id")
    names = [n for n, _ in C.SENSITIVE_PATTERNS]
    return scan.where(sum((F.col(n) for n in names), F.lit(0)) > 0)


@register("external_ref_counts", """
SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '(?i)https?://[^\\s"'']+\\.(js|css|png|svg|woff)'),
                      lambda x: NOT regexp_matches(x, '(?i)^https?://(127\\.0\\.0\\.1|localhost)'))) AS BIGINT) AS external_refs
FROM pages""")
def external_ref_counts(spark, sf_dir):
    """external static-asset references per page (non-local http(s) URL ending js/css/png/svg/woff)."""
    return Q.external_ref_counts(read_table(spark, sf_dir, "pages"), "html", "page_id")


@register("prediction_domain_violations", S.with_ctes("""
SELECT rule, violations FROM (
  SELECT CAST(sum(CASE WHEN prediction_context NOT IN ('opening', 'simulation') THEN 1 ELSE 0 END) AS BIGINT) AS context_domain,
         CAST(sum(CASE WHEN status NOT IN ('success', 'failed') THEN 1 ELSE 0 END) AS BIGINT) AS status_domain,
         CAST(sum(CASE WHEN risk_level IS NOT NULL AND risk_level NOT IN ('low', 'medium', 'high') THEN 1 ELSE 0 END)
              AS BIGINT) AS risk_level_domain,
         CAST(sum(CASE WHEN risk_score IS NOT NULL AND (risk_score < 0 OR risk_score > 100) THEN 1 ELSE 0 END) AS BIGINT)
           AS risk_score_range,
         CAST(sum(CASE WHEN predicted_is_delayed IS NOT NULL AND predicted_is_delayed NOT IN (0, 1) THEN 1 ELSE 0 END)
              AS BIGINT) AS decision_domain,
         CAST(sum(CASE WHEN status = 'success' AND delay_probability IS NULL AND predicted_hours IS NULL THEN 1 ELSE 0 END)
              AS BIGINT) AS success_has_output
  FROM preds2) UNPIVOT (violations FOR rule IN (context_domain, status_domain, risk_level_domain, risk_score_range,
                                                decision_domain, success_has_output))""", "preds2"))
def prediction_domain_violations(spark, sf_dir):
    """check-constraint violations on the prediction table, one aggregate pass."""
    p = V.prediction_view(spark, sf_dir)
    rules = {
        "context_domain": F.col("prediction_context").isin("opening", "simulation"),
        "status_domain": F.col("status").isin(*C.PREDICTION_STATUSES),
        "risk_level_domain": F.col("risk_level").isin(*C.RISK_LEVELS),
        "risk_score_range": F.col("risk_score").between(0, 100),
        "decision_domain": F.col("predicted_is_delayed").isin(0, 1),
        "success_has_output": ~((F.col("status") == "success") & F.col("delay_probability").isNull()
                                & F.col("predicted_hours").isNull()),
    }
    return Q.domain_violations(p, rules)


# Run and issue records derived from orders and line items, with values outside the domains on purpose.
_COUNTERS = ["total_rows", "imported_rows", "inserted_rows", "updated_rows", "skipped_duplicate_rows", "quarantined_rows", "error_rows", "warning_count"]
_RUN_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'paused' END"
_RUN_COUNTERS = ", ".join(f"CAST(floor(o_totalprice) AS BIGINT) % {7 + i} - {i % 3} AS {c}" for i, c in enumerate(_COUNTERS))
_ISSUE_COLS = """CASE l_returnflag WHEN 'A' THEN 'warning' WHEN 'N' THEN 'error' ELSE 'fatal' END AS severity,
                 CASE l_linestatus WHEN 'O' THEN 'INVALID_DATE' ELSE CASE WHEN l_linenumber = 1 THEN NULL ELSE 'SOMETHING_ELSE' END END AS issue_code"""


def _rules_sql(rules, source):
    parts = [f"SELECT '{n}' AS rule, CAST(coalesce(sum(CASE WHEN {bad} THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM {source}" for n, bad in rules.items()]
    return "\nUNION ALL ".join(parts)


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


@register("run_issue_domain_violations", f"""
WITH runs AS (SELECT {_RUN_STATUS} AS status, {_RUN_COUNTERS} FROM orders), issues AS (SELECT {_ISSUE_COLS} FROM lineitem)
""" + _rules_sql({"status_domain": f"status NOT IN ({_in(C.IMPORT_STATUSES)})", **{f"{c}_not_negative": f"{c} < 0" for c in _COUNTERS}}, "runs")
          + "\nUNION ALL " + _rules_sql({"severity_domain": f"severity NOT IN ({_in(C.SEVERITIES)})",
                                         "issue_code_domain": f"issue_code NOT IN ({_in(C.ISSUE_CODES)})"}, "issues"))
def run_issue_domain_violations(spark, sf_dir):
    """check-constraint violations of import runs and issues, one aggregate pass each."""
    runs = read_table(spark, sf_dir, "orders").selectExpr(f"{_RUN_STATUS} AS status", *_RUN_COUNTERS.split(", "))
    issues = read_table(spark, sf_dir, "lineitem").selectExpr(*[c.strip() for c in _ISSUE_COLS.split(",\n")])
    return Q.domain_violations(runs, Q.run_rules()).unionByName(Q.domain_violations(issues, Q.issue_rules()))
