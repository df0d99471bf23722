"""Registered queries: ingest of two deliveries derived from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket import config as C
from docket.operators import ingest as I
from docket.operators import quality as Q
from docket.plans import sql as S
from docket.plans import views as V
from docket.plans.registry import register
from docket.session import drop_shuffles, drop_stored, stored

MV = C.CANONICAL_MAPPING_VERSION


# ---------------------------------------------------------------- Spark side
def _catalog(spark, sf_dir):
    return V.ingest_catalog(spark, sf_dir)


def _state1(spark, sf_dir):
    r1 = I.run_import(V.delivery(spark, sf_dir, 1), V.empty_state(spark), _catalog(spark, sf_dir))
    st = r1["state"]
    # processes 12 mod 59 were stored under an older catalog version
    st = st.withColumn("e_mapping_version", F.when(F.col("external_id").cast("long") % 59 == 12, F.lit("0.9.0"))
                       .otherwise(F.col("e_mapping_version")))
    # the state after the first delivery is a stored table, not a recomputation
    return r1, stored(st)


def _runs(spark, sf_dir, first=(), state=False):
    """Both imports; each delivery is imported once.  Of the first, the outputs ``first`` are kept, as stored tables; of the second all but
    its state, which is kept on request."""
    r1, st1 = _state1(spark, sf_dir)
    held, r1 = r1.get("held", ()), {k: stored(r1[k]) for k in first}
    drop_stored(*held)
    drop_shuffles(spark)
    r2 = I.run_import(V.delivery(spark, sf_dir, 2), st1, _catalog(spark, sf_dir))
    if not state:
        del r2["state"]
        drop_stored(st1)
    return r1, r2


# ---------------------------------------------------------------- SQL side
def _fmt(x):
    return f"coalesce(strftime({x}, '%Y-%m-%d %H:%M:%S'), '')"


def _other(x):
    return f"(CASE WHEN {x} = 'FRANCE' THEN 'GERMANY' ELSE 'FRANCE' END)"


def _code(col, known):
    t = f"trim({col})"
    return (f"(CASE WHEN {col} IS NULL OR {t} = '' THEN 'missing' WHEN {t} IN (SELECT {known}) "
            f"THEN {S.code_sql(t)} ELSE 'unknown' END)")


def _unk(col, known):
    return f"(CASE WHEN {col} IS NOT NULL AND trim({col}) <> '' AND trim({col}) NOT IN (SELECT {known}) THEN 1 ELSE 0 END)"


_KNOWN = {
    "source": "r_name FROM region",
    "subject": "c_mktsegment FROM customer",
    "reason": "o_orderpriority FROM orders",
    "type": "p_brand FROM part",
    "neighborhood": "n_name FROM nation",
    "department": "NULL::VARCHAR WHERE false",
}


def _ts(x):
    return f"try_cast(nullif(trim({x}), '') AS TIMESTAMP)"


def _bad(x):
    return f"(trim({x}) <> '' AND {_ts(x)} IS NULL)"


def _norm_ts(x):
    return f"coalesce({S.iso_sql(x)}, '<<null>>')"


def _norm_s(x):
    return f"(CASE WHEN {x} IS NULL THEN '<<null>>' WHEN trim({x}) = '' THEN '<<empty>>' ELSE trim({x}) END)"


def _json(pairs):
    return "('{' || " + " || ',' || ".join(f"'\"{k}\":\"' || {v} || '\"'" for k, v in pairs) + " || '}')"


_OPEN = [("created_at", _norm_ts("created_at")), ("deadline", _norm_ts("deadline")), ("external_id", _norm_s("eid")),
         ("neighborhood", "neighborhood_code"), ("reason", "reason_code"), ("source", "source_code"),
         ("subject", "subject_code"), ("type", "type_code")]
_OUT = [("closure_reason", _norm_s("closure_r")), ("completed_at", _norm_ts("completed_at")),
        ("current_status", _norm_s("status"))]
_ROWFP = [(f"opening__{k}", v) for k, v in _OPEN] + [(f"outcome__{k}", v) for k, v in _OUT]

_MSG_SQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I._MESSAGES.items()) + " END"

_INGEST_CTES = f"""
prx AS (SELECT praw.*, CASE WHEN completed_at IS NULL THEN 'Open' ELSE 'Closed' END AS current_status,
               CASE WHEN completed_at IS NULL THEN NULL WHEN o_orderstatus = 'F' THEN 'Case Resolved'
                    ELSE 'Case Noted' END AS closure_reason FROM praw),
b1 AS (SELECT o_orderkey,
         CASE WHEN o_orderkey % 101 = 3 THEN '' ELSE external_id END AS case_enquiry_id,
         CASE WHEN o_orderkey % 103 = 4 THEN 'not-a-date' WHEN o_orderkey % 107 = 5 THEN '' ELSE {_fmt('created_at')} END
           AS open_dt,
         '' AS closed_dt,
         CASE WHEN o_orderkey % 109 = 6 THEN '2024-02-30' ELSE {_fmt('deadline')} END AS sla_target_dt,
         'Open' AS case_status,
         CASE WHEN o_orderkey % 37 = 7 THEN 'Walk-in Kiosk' ELSE coalesce(source, '') END AS source,
         coalesce(subject, '') AS subject, coalesce(reason, '') AS reason, coalesce(type, '') AS type,
         coalesce(neighborhood, '') AS neighborhood,
         CASE WHEN o_orderkey % 41 = 8 THEN 'Public Works' ELSE '' END AS department,
         '' AS closure_reason, 'batch1.csv' AS _file, 1 AS _file_seq, o_orderkey + 1 AS _row
       FROM prx),
b2b AS (SELECT o_orderkey, external_id AS case_enquiry_id, {_fmt('created_at')} AS open_dt,
          CASE WHEN o_orderkey % 113 = 7 THEN 'yesterday' ELSE {_fmt('completed_at')} END AS closed_dt,
          {_fmt('deadline')} AS sla_target_dt, current_status AS case_status,
          CASE WHEN o_orderkey % 37 = 7 THEN 'Walk-in Kiosk' ELSE coalesce(source, '') END AS source,
          coalesce(subject, '') AS subject, coalesce(reason, '') AS reason, coalesce(type, '') AS type,
          CASE WHEN o_orderkey % 43 = 9 THEN {_other("coalesce(neighborhood, '')")} ELSE coalesce(neighborhood, '') END
            AS neighborhood,
          coalesce(neighborhood, '') AS orig_hood,
          CASE WHEN o_orderkey % 41 = 8 THEN 'Public Works' ELSE '' END AS department,
          coalesce(closure_reason, '') AS closure_reason
        FROM prx),
b2 AS (SELECT o_orderkey, case_enquiry_id, open_dt, closed_dt, sla_target_dt, case_status, source, subject, reason, type,
              neighborhood, department, closure_reason, 'batch2.csv' AS _file, 2 AS _file_seq, o_orderkey * 2 + 1 AS _row
       FROM b2b
       UNION ALL
       SELECT o_orderkey, case_enquiry_id, open_dt, closed_dt, sla_target_dt, case_status, source, subject, reason, type,
              CASE WHEN o_orderkey % 47 = 10 THEN neighborhood ELSE {_other('orig_hood')} END, department, closure_reason,
              'batch2.csv', 2, o_orderkey * 2 + 2
       FROM b2b WHERE o_orderkey % 47 = 10 OR o_orderkey % 53 = 11),
bb AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2),
v AS (SELECT bb.*, nullif(trim(case_enquiry_id), '') AS eid,
         {_ts('open_dt')} AS created_at, {_ts('sla_target_dt')} AS deadline, {_ts('closed_dt')} AS completed_at,
         nullif(trim(case_status), '') AS status, nullif(trim(closure_reason), '') AS closure_r,
         CASE WHEN nullif(trim(case_enquiry_id), '') IS NULL THEN 'REQUIRED_FIELD_MISSING'
              WHEN {_bad('open_dt')} THEN 'INVALID_DATE' WHEN trim(open_dt) = '' THEN 'REQUIRED_FIELD_MISSING'
              WHEN {_bad('sla_target_dt')} THEN 'INVALID_DATE' WHEN {_bad('closed_dt')} THEN 'INVALID_DATE' END AS error_code,
         CASE WHEN nullif(trim(case_enquiry_id), '') IS NULL THEN 'case_enquiry_id'
              WHEN {_bad('open_dt')} THEN 'open_dt' WHEN trim(open_dt) = '' THEN 'open_dt'
              WHEN {_bad('sla_target_dt')} THEN 'sla_target_dt' WHEN {_bad('closed_dt')} THEN 'closed_dt' END AS error_field
      FROM bb),
mc AS (SELECT v.*, {", ".join(f"{_code(c, k)} AS {c}_code, {_unk(c, k)} AS {c}_unknown" for c, k in _KNOWN.items())}
       FROM v WHERE error_code IS NULL),
m AS (SELECT mc.*, sha256({_json(_OPEN)}) AS opening_fp, sha256({_json(_ROWFP)}) AS row_fp FROM mc),
st1 AS (SELECT eid, opening_fp AS e_opening_fp, row_fp AS e_row_fp,
               CASE WHEN CAST(eid AS BIGINT) % 59 = 12 THEN '0.9.0' ELSE '{MV}' END AS e_mapping_version,
               created_at, deadline, completed_at, status, closure_r, type_code
        FROM m WHERE _file_seq = 1),
f2 AS (SELECT *, first_value(opening_fp) OVER (PARTITION BY eid ORDER BY _row) AS first_fp,
              row_number() OVER (PARTITION BY eid ORDER BY _row) AS rn FROM m WHERE _file_seq = 2),
j2 AS (SELECT f2.*, s.eid IS NOT NULL AS ex, s.e_opening_fp, s.e_row_fp, s.e_mapping_version,
              coalesce(f2.opening_fp = CASE WHEN s.eid IS NOT NULL THEN s.e_opening_fp ELSE f2.first_fp END, false) AS on_base
       FROM f2 LEFT JOIN st1 s ON f2.eid = s.eid),
l2 AS (SELECT *, CASE WHEN on_base THEN lag(row_fp) OVER (PARTITION BY eid, on_base ORDER BY _row) END AS prev_in FROM j2),
d2 AS (SELECT *, CASE WHEN NOT ex AND rn = 1 THEN 'insert'
                      WHEN e_mapping_version IS NOT NULL AND e_mapping_version <> '{MV}' THEN 'CANONICAL_MAPPING_MISMATCH'
                      WHEN coalesce(row_fp = coalesce(prev_in, e_row_fp), false) THEN 'skip'
                      WHEN on_base THEN 'update' ELSE 'OPENING_DATA_CONFLICT' END AS decision FROM l2),
d1 AS (SELECT *, 'insert' AS decision FROM m WHERE _file_seq = 1),
outc AS (SELECT _file, _row, eid AS external_id, decision FROM d1
         UNION ALL SELECT _file, _row, eid, decision FROM d2
         UNION ALL SELECT _file, _row, eid, error_code FROM v WHERE error_code IS NOT NULL),
iss AS (SELECT _file AS import_run, _row AS row_number, error_field AS column_name, error_code AS issue_code,
               'error' AS severity, 'row ' || _row || ': ' || ({_MSG_SQL.format(c='error_code')}) AS issue_message
        FROM v WHERE error_code IS NOT NULL
        UNION ALL
        SELECT _file, _row, c.col, 'UNKNOWN_CANONICAL_MAPPING', 'warning',
               'row ' || _row || ': {I._MESSAGES['UNKNOWN_CANONICAL_MAPPING']}'
        FROM m, (SELECT unnest(['source', 'subject', 'reason', 'type', 'neighborhood', 'department']) AS col) c
        WHERE (c.col = 'source' AND source_unknown = 1) OR (c.col = 'subject' AND subject_unknown = 1)
           OR (c.col = 'reason' AND reason_unknown = 1) OR (c.col = 'type' AND type_unknown = 1)
           OR (c.col = 'neighborhood' AND neighborhood_unknown = 1) OR (c.col = 'department' AND department_unknown = 1)
        UNION ALL
        SELECT _file, _row, NULL, decision, 'error', 'row ' || _row || ': ' || ({_MSG_SQL.format(c='decision')})
        FROM d2 WHERE decision IN ('CANONICAL_MAPPING_MISMATCH', 'OPENING_DATA_CONFLICT')),
cnt AS (SELECT o._file AS import_run, count(*) AS total_rows,
               CAST(sum(CASE WHEN decision = 'insert' THEN 1 ELSE 0 END) AS BIGINT) AS inserted_rows,
               CAST(sum(CASE WHEN decision = 'update' THEN 1 ELSE 0 END) AS BIGINT) AS updated_rows,
               CAST(sum(CASE WHEN decision = 'skip' THEN 1 ELSE 0 END) AS BIGINT) AS skipped_duplicate_rows,
               CAST(sum(CASE WHEN decision NOT IN ('insert', 'update', 'skip') THEN 1 ELSE 0 END) AS BIGINT)
                 AS quarantined_rows
        FROM outc o GROUP BY o._file),
runs AS (SELECT cnt.*, quarantined_rows AS error_rows,
                coalesce((SELECT count(*) FROM iss WHERE iss.import_run = cnt.import_run AND severity = 'warning'), 0)
                  AS warning_count,
                CASE WHEN quarantined_rows > 0 AND inserted_rows + updated_rows > 0 THEN 'completed_with_issues'
                     WHEN quarantined_rows > 0 THEN 'failed' ELSE 'completed' END AS status,
                inserted_rows + updated_rows AS imported_rows
         FROM cnt)"""


def _isql(body: str) -> str:
    return S.with_ctes("", "praw").rstrip() + "," + _INGEST_CTES + "\n" + body


_ISSUE_COLS = ["import_run", "row_number", "column_name", "issue_code", "severity", "issue_message"]
_RUN_COLS = ["import_run", "status", "total_rows", "inserted_rows", "updated_rows", "skipped_duplicate_rows",
             "quarantined_rows", "error_rows", "warning_count", "imported_rows"]


@register("ingest_issues", _isql(f"SELECT {', '.join(_ISSUE_COLS)} FROM iss"))
def ingest_issues(spark, sf_dir):
    """F2 first-error, F3 warnings and W4 errors of both deliveries (no raw values stored)."""
    r1, r2 = _runs(spark, sf_dir, ("issues",))
    return r1["issues"].unionByName(r2["issues"]).select(*_ISSUE_COLS)


@register("ingest_run_counts", _isql(f"SELECT {', '.join(_RUN_COLS)} FROM runs"))
def ingest_run_counts(spark, sf_dir):
    """A1: counters and final status of both import runs."""
    r1, r2 = _runs(spark, sf_dir, ("counts",))
    return r1["counts"].unionByName(r2["counts"]).select(*_RUN_COLS)


@register("ingest_decisions", _isql("SELECT _file AS import_run, _row AS row_number, external_id, decision FROM outc "
                                    "WHERE _file = 'batch2.csv'"))
def ingest_decisions(spark, sf_dir):
    """W4 + J3: per-row decision of the outcome delivery against the stored state (file order)."""
    return _runs(spark, sf_dir)[1]["rows"].select(F.col("_file").alias("import_run"), F.col("_row").alias("row_number"),
                                              "external_id", "decision")


@register("process_state", _isql(f"""
, last2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY _row DESC) AS rk FROM d2
                           WHERE decision IN ('insert', 'update')) WHERE rk = 1)
SELECT coalesce(s.eid, l.eid) AS external_id,
       CASE WHEN l.eid IS NOT NULL THEN l.completed_at ELSE s.completed_at END AS completed_at,
       CASE WHEN l.eid IS NOT NULL THEN l.status ELSE s.status END AS current_status,
       CASE WHEN l.eid IS NOT NULL THEN l.closure_r ELSE s.closure_r END AS closure_reason,
       coalesce(s.type_code, l.type_code) AS process_type,
       CASE WHEN l.eid IS NOT NULL THEN l.row_fp ELSE s.e_row_fp END AS e_row_fp,
       CASE WHEN l.eid IS NOT NULL THEN '{MV}' ELSE s.e_mapping_version END AS e_mapping_version,
       CASE WHEN l.eid IS NOT NULL THEN 'batch2.csv' ELSE 'batch1.csv' END AS last_import
FROM st1 s FULL OUTER JOIN last2 l ON s.eid = l.eid"""))
def process_state(spark, sf_dir):
    """W5 + S7: processes after both deliveries (outcomes of the last accepted row; opening untouched)."""
    return _runs(spark, sf_dir, state=True)[1]["state"].select(
        "external_id", "completed_at", "current_status", "closure_reason", "process_type", "e_row_fp",
        "e_mapping_version", "last_import")


@register("opening_snapshots_written", _isql("""
SELECT eid AS external_id, '{' || '"created_at":' || to_json(""" + S.iso_sql("created_at") + """)
       || ',"deadline":' || coalesce(to_json(""" + S.iso_sql("deadline") + """), 'null')
       || ',"external_id":' || to_json(eid) || ',"neighborhood":' || to_json(neighborhood_code)
       || ',"reason":' || to_json(reason_code) || ',"source":' || to_json(source_code)
       || ',"subject":' || to_json(subject_code) || ',"type":' || to_json(type_code) || '}' AS input_json,
       opening_fp AS input_fingerprint, _file AS source_import
FROM (SELECT * FROM d1 UNION ALL SELECT * EXCLUDE (first_fp, rn, ex, e_opening_fp, e_row_fp, e_mapping_version,
                                                    on_base, prev_in) FROM d2 WHERE decision = 'insert')"""))
def opening_snapshots_written(spark, sf_dir):
    """P9 + S7: the immutable opening snapshots created by both runs."""
    r1, r2 = _runs(spark, sf_dir, ("snapshots",))
    s = r1["snapshots"].unionByName(r2["snapshots"])
    return s.select("external_id", "input_json", "input_fingerprint", "source_import")


@register("delivery_duplicate_keys", _isql("""
SELECT case_enquiry_id, count(*) AS count FROM b2 WHERE trim(case_enquiry_id) <> ''
GROUP BY 1 HAVING count(*) > 1 ORDER BY count DESC, case_enquiry_id LIMIT 10"""))
def delivery_duplicate_keys(spark, sf_dir):
    """A10: top-10 repeated keys in the outcome delivery."""
    return Q.duplicate_keys(V.delivery(spark, sf_dir, 2), "case_enquiry_id", 10)


@register("data_quality_summary", _isql("""
SELECT count(*) AS total_import_runs, CAST(sum(total_rows) AS BIGINT) AS total_rows,
       CAST(sum(imported_rows) AS BIGINT) AS imported_rows, CAST(sum(quarantined_rows) AS BIGINT) AS quarantined_rows,
       CAST(sum(error_rows) AS BIGINT) AS error_rows, CAST(sum(warning_count) AS BIGINT) AS warning_count,
       (SELECT count(*) FROM iss) AS issue_count,
       (SELECT count(*) FROM iss WHERE severity = 'error') AS error_issues,
       (SELECT count(*) FROM iss WHERE severity = 'warning') AS warning_issues
FROM runs"""))
def data_quality_summary(spark, sf_dir):
    """Run totals and issues by severity."""
    r1, r2 = _runs(spark, sf_dir, ("counts", "issues"))
    return Q.run_summary(r1["counts"].unionByName(r2["counts"]), r1["issues"].unionByName(r2["issues"]))


@register("issues_by_code", _isql("SELECT coalesce(issue_code, 'UNKNOWN') AS code, count(*) AS count FROM iss GROUP BY 1"))
def issues_by_code(spark, sf_dir):
    """Issue counts by code (NULL -> UNKNOWN)."""
    r1, r2 = _runs(spark, sf_dir, ("issues",))
    return Q.issues_by_code(r1["issues"].unionByName(r2["issues"]))


@register("recent_runs", _isql(f"""
SELECT import_run, run_id, completed_at, status, total_rows, imported_rows, quarantined_rows, error_rows, warning_count
FROM (SELECT runs.*, CAST(CASE WHEN import_run = 'batch1.csv' THEN 1 ELSE 2 END AS BIGINT) AS run_id,
             TIMESTAMP '{C.TEST_AS_OF:%Y-%m-%d %H:%M:%S}' + INTERVAL (CASE WHEN import_run = 'batch1.csv' THEN 1 ELSE 2 END) HOUR
               AS completed_at FROM runs)
ORDER BY completed_at DESC, run_id DESC LIMIT {C.RECENT_RUNS}"""))
def recent_runs(spark, sf_dir):
    """Latest runs by completion time then id (run n completes n hours after the as-of time)."""
    r1, r2 = _runs(spark, sf_dir, ("counts",))
    runs = r1["counts"].withColumn("run_id", F.lit(1)).unionByName(r2["counts"].withColumn("run_id", F.lit(2)))
    from docket.functions import exprs as X

    runs = runs.withColumn("completed_at", F.timestamp_add("HOUR", F.col("run_id"), X.ts_lit(C.TEST_AS_OF)))
    return Q.recent_runs(runs).select("import_run", "run_id", "completed_at", "status", "total_rows", "imported_rows",
                                      "quarantined_rows", "error_rows", "warning_count")
