"""Plain-SQL twins of :mod:`docket.plans.views` for the DuckDB oracle.

``with_ctes(body, *names)`` prefixes a query with the named CTEs (and their
dependencies, in order).  SQL here is ANSI-ish DuckDB dialect; integer
outputs are cast to BIGINT and doubles rounded in the final projections so
results compare exactly with the Spark side.
"""

from __future__ import annotations

from docket import config as C


def code_sql(x: str) -> str:
    """Canonical code rule + 'missing' for blank (twin of views._code)."""
    rule = (
        f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[&/]', ' and ', 'g'), "
        f"'[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    )
    return f"(CASE WHEN nullif(trim({x}), '') IS NULL THEN 'missing' ELSE {rule} END)"


def iso_sql(x: str) -> str:
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL WHEN microsecond({x}) % 1000000 = 0 "
        f"THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END)"
    )


def hours_sql(a: str, b: str) -> str:
    return f"(CAST(date_diff('microsecond', {a}, {b}) AS DOUBLE) / 3.6e9)"


def split_sql(x: str, splits=C.TEST_SPLITS) -> str:
    whens = " ".join(
        f"WHEN {x} >= TIMESTAMP '{s:%Y-%m-%d %H:%M:%S}' AND {x} < TIMESTAMP '{e:%Y-%m-%d %H:%M:%S}' THEN '{n}'"
        for n, s, e in splits
    )
    return f"(CASE {whens} ELSE NULL END)"


def is_delayed_sql(done: str, dl: str, cutoff=C.TEST_CUTOFF) -> str:
    return (
        f"(CASE WHEN {dl} IS NULL THEN NULL WHEN {done} IS NOT NULL THEN "
        f"(CASE WHEN {done} <= {dl} THEN 0 ELSE 1 END) "
        f"WHEN {dl} < TIMESTAMP '{cutoff:%Y-%m-%d %H:%M:%S}' THEN 1 ELSE NULL END)"
    )


def risk_score_sql(p: str) -> str:
    # round-half-even of 100p, clamped to [0, 100]
    return f"CAST(CASE WHEN {p} IS NOT NULL THEN least(greatest(round_even({p} * 100, 0), 0), 100) END AS INTEGER)"


def risk_level_sql(s: str) -> str:
    return (
        f"(CASE WHEN {s} IS NULL THEN NULL WHEN {s} <= {C.RISK_LOW_MAX} THEN 'low' "
        f"WHEN {s} <= {C.RISK_MEDIUM_MAX} THEN 'medium' ELSE 'high' END)"
    )


_deadline_cases = " ".join(
    f"WHEN '{p}' THEN po.o_orderdate + INTERVAL {d} DAY" for p, d in C.PRIORITY_SLA_DAYS.items()
)

CTES: dict[str, tuple[tuple[str, ...], str]] = {}

CTES["po"] = ((), """
po AS (
  SELECT o.o_orderkey,
         any_value(o.o_custkey) AS o_custkey, any_value(o.o_orderstatus) AS o_orderstatus,
         any_value(o.o_orderdate) AS o_orderdate, any_value(o.o_orderpriority) AS o_orderpriority,
         min(CASE WHEN l.l_shipdate >= o.o_orderdate THEN l.l_shipdate END) AS first_ship,
         max(l.l_shipdate) AS last_ship,
         min(l.l_partkey) AS first_partkey
  FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
  GROUP BY o.o_orderkey)""")

CTES["praw"] = (("po",), f"""
praw AS (
  SELECT po.o_orderkey,
         CAST(po.o_orderkey AS VARCHAR) AS external_id,
         po.o_orderdate AS created_at,
         CASE po.o_orderpriority {_deadline_cases} ELSE NULL END AS deadline,
         CASE WHEN po.o_orderstatus <> 'O' THEN coalesce(po.first_ship, po.last_ship) END AS completed_at,
         po.o_orderstatus,
         r.r_name AS source, c.c_mktsegment AS subject, po.o_orderpriority AS reason,
         p.p_brand AS type, n.n_name AS neighborhood, CAST(NULL AS VARCHAR) AS department
  FROM po
  LEFT JOIN part p ON po.first_partkey = p.p_partkey
  LEFT JOIN customer c ON po.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)""")

CTES["pv"] = (("praw",), f"""
pv AS (
  SELECT o_orderkey, external_id, created_at, deadline, completed_at,
         CASE WHEN completed_at IS NULL THEN 'Open' ELSE 'Closed' END AS current_status,
         CASE WHEN completed_at IS NULL THEN NULL WHEN o_orderstatus = 'F' THEN 'Case Resolved'
              ELSE 'Case Noted' END AS closure_reason,
         {code_sql('source')} AS source, {code_sql('subject')} AS subject, {code_sql('reason')} AS reason,
         {code_sql('type')} AS type, {code_sql('neighborhood')} AS neighborhood,
         {code_sql('type')} AS process_type
  FROM praw)""")

CTES["pt"] = (("pv",), f"""
pt AS (
  SELECT pv.*,
         CAST(month(created_at) AS BIGINT) AS open_month,
         CAST(isodow(created_at) - 1 AS BIGINT) AS open_weekday,
         CAST(hour(created_at) AS BIGINT) AS open_hour,
         CAST(CASE WHEN isodow(created_at) - 1 >= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
         CASE WHEN {hours_sql('created_at', 'deadline')} >= 0 THEN {hours_sql('created_at', 'deadline')} END
           AS sla_duration_hours,
         {is_delayed_sql('completed_at', 'deadline')} AS is_delayed,
         CASE WHEN {hours_sql('created_at', 'completed_at')} >= 0 THEN {hours_sql('created_at', 'completed_at')} END
           AS total_duration_hours,
         {split_sql('created_at')} AS split
  FROM pv)""")

# Dataset rows: F6 drops k%83=5; k%97=13 and k%89=7 are schema errors.
CTES["ds"] = (("pt",), """
ds AS (
  SELECT external_id, created_at, split, o_orderkey,
         (o_orderkey % 97 = 13 OR o_orderkey % 89 = 7) AS bad,
         source, subject, reason, type, neighborhood, open_month, open_weekday, open_hour, is_weekend,
         sla_duration_hours, is_delayed, total_duration_hours
  FROM pt WHERE NOT (o_orderkey % 83 = 5))""")

CTES["dsx"] = (("ds",), """
dsx AS (
  SELECT external_id, created_at, split,
         CASE WHEN bad THEN NULL ELSE source END AS source,
         CASE WHEN bad THEN NULL ELSE subject END AS subject,
         CASE WHEN bad THEN NULL ELSE reason END AS reason,
         CASE WHEN bad THEN NULL ELSE type END AS type,
         CASE WHEN bad THEN NULL ELSE neighborhood END AS neighborhood,
         CASE WHEN bad THEN NULL ELSE open_month END AS open_month,
         CASE WHEN bad THEN NULL ELSE open_weekday END AS open_weekday,
         CASE WHEN bad THEN NULL ELSE open_hour END AS open_hour,
         CASE WHEN bad THEN NULL ELSE is_weekend END AS is_weekend,
         CASE WHEN bad THEN NULL ELSE sla_duration_hours END AS sla_duration_hours,
         CASE WHEN bad THEN NULL ELSE is_delayed END AS is_delayed,
         CASE WHEN bad THEN NULL ELSE total_duration_hours END AS total_duration_hours,
         CAST(CASE WHEN bad THEN 1 ELSE 0 END AS BIGINT) AS schema_error
  FROM ds)""")

# Scoring features: any schema version, absent key -> missing; only malformed JSON (k%89=7, unless k%97=13) fails.
CTES["sfx"] = (("pt",), """
sfx AS (
  SELECT external_id, o_orderkey,
         CASE WHEN bad THEN NULL ELSE source END AS source, CASE WHEN bad THEN NULL ELSE subject END AS subject,
         CASE WHEN bad THEN NULL ELSE reason END AS reason, CASE WHEN bad THEN NULL ELSE type END AS type,
         CASE WHEN bad THEN NULL WHEN o_orderkey % 97 = 13 THEN 'missing' ELSE neighborhood END AS neighborhood,
         CASE WHEN bad THEN NULL ELSE open_month END AS open_month,
         CASE WHEN bad THEN NULL ELSE open_weekday END AS open_weekday,
         CASE WHEN bad THEN NULL ELSE open_hour END AS open_hour,
         CASE WHEN bad THEN NULL ELSE is_weekend END AS is_weekend,
         CASE WHEN bad THEN NULL ELSE sla_duration_hours END AS sla_duration_hours,
         CASE WHEN bad THEN NULL ELSE CAST(CASE WHEN deadline IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) END AS has_sla,
         CAST(CASE WHEN bad THEN 1 ELSE 0 END AS BIGINT) AS feature_error
  FROM (SELECT *, (o_orderkey % 97 <> 13 AND o_orderkey % 89 = 7) AS bad FROM pt))""")

CTES["preds"] = ((), f"""
preds AS (
  SELECT event_id AS id, user_id AS process_id, user_id AS snapshot_id,
         CAST(CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END AS BIGINT) AS model_bundle_id,
         CASE WHEN event_type = 'signup' THEN 'v2' ELSE 'v1' END AS model_version,
         CASE WHEN event_type = 'purchase' THEN 'simulation' ELSE 'opening' END AS prediction_context,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN event_type <> 'error' THEN round(value / 500.0, 6) END AS delay_probability,
         CASE WHEN event_type <> 'error' AND user_id % 7 <> 0 THEN
              CAST(CASE WHEN round(value / 500.0, 6) >= {C.DEFAULT_THRESHOLD} THEN 1 ELSE 0 END AS INTEGER) END
           AS predicted_is_delayed,
         CASE WHEN event_type <> 'error' THEN value END AS predicted_hours,
         ts AS predicted_at, props
  FROM events)""")

CTES["preds2"] = (("preds",), f"""
preds2 AS (
  SELECT *, {risk_score_sql('delay_probability')} AS risk_score,
         {risk_level_sql(risk_score_sql('delay_probability'))} AS risk_level
  FROM preds)""")

CTES["scored"] = (("pt",), """
scored AS (
  SELECT pt.external_id, pt.split, pt.created_at, pt.is_delayed AS y,
         CAST(30 * coalesce(pt.is_delayed, 0) + floor(CAST(floor(o.o_totalprice * 7) % 100 AS BIGINT) * 7 / 10) AS DOUBLE)
           / CAST(100.0 AS DOUBLE) AS p,
         pt.total_duration_hours AS y_hours,
         coalesce(pt.sla_duration_hours, 720.0) AS yhat_hours
  FROM pt JOIN orders o ON pt.o_orderkey = o.o_orderkey)""")


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        deps, _ = CTES[n]
        for d in deps:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",".join(CTES[n][1] for n in order) + "\n" + body
