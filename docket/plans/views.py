"""Case tables derived from the provided TPC-H-like test tables.

There are no case tables in the test data, so the case model is derived from
``orders`` / ``lineitem`` / ``customer`` / ``nation`` / ``region`` / ``part``
and ``events``.  Each derivation here has a twin in :mod:`docket.plans.sql`
written in plain SQL, so the DuckDB oracle computes exactly the same input.

Scale notes (SF100: lineitem 600 M rows, orders 150 M):
* orders and lineitem are joined once on the order key; the per-order
  aggregate reuses that hash partitioning (no second shuffle);
* part, customer, nation and region are joined on their keys (shuffle or
  broadcast, decided by the optimizer from real sizes).
* Defects for the ingest/dataset fixtures are injected by a key rule, never
  by dropping rows: every order is processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket import config as C
from docket.functions import exprs as X
from docket.session import read_table

def _deadline(orderdate, priority):
    out = None
    for prio, days in C.PRIORITY_SLA_DAYS.items():
        cond = priority == prio
        val = F.timestamp_add("DAY", F.lit(days), orderdate)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.lit(None).cast("timestamp_ntz"))


def process_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived case table, written once per session to the checkpoint folder.

    Processes, snapshots and deliveries are all projections of this one
    table; in the reproduced system they are stored tables, so the join of
    orders and lineitem is paid once instead of once per view.
    """
    return _cases(spark, sf_dir).drop(*[f"code_{c}" for c in C.CATEGORICAL_FEATURES])


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored case table: :func:`process_raw` and the canonical codes of its categories (``code_*``)."""
    return materialized(spark, sf_dir, "cases", _derived_cases)


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Parquet copy of ``build(spark, sf_dir)`` under the session's checkpoint folder."""
    import hashlib

    from docket.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    key = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/derived/{key}/{name}"
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        build(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _process_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per order with raw (uncoded) categorical text.

    Columns: o_orderkey, external_id, created_at, deadline, completed_at,
    current_status, closure_reason, source, subject, reason, type,
    neighborhood, department.
    """
    return _derived_cases(spark, sf_dir).drop(*[f"code_{c}" for c in C.CATEGORICAL_FEATURES])


def _derived_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`_process_raw` with the codes.  Labels of dimension tables are coded there, before the joins, not once a case."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    # Order attributes are functionally dependent on the key: grouping by them
    # keeps fixed-width buffers (HashAggregate) instead of first() on strings.
    per_order = (
        # lineitem is the fact table: never a broadcast candidate; sort-merge on the
        # order key, and the aggregate below reuses that partitioning.
        o.join(li.hint("merge"), o.o_orderkey == li.l_orderkey, "left")
        .groupBy("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        .agg(
            F.min(F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate"))).alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
            # line numbers repeat within an order in the test data: take the lowest part key
            F.min("l_partkey").alias("first_partkey"),
        )
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", _code(F.col("p_brand")).alias("code_type"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", _code(F.col("c_mktsegment")).alias("code_subject"))
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", _code(F.col("n_name")).alias("code_neighborhood"))
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name", _code(F.col("r_name")).alias("code_source"))
    done = F.when(F.col("o_orderstatus") != "O", F.coalesce("first_ship", "last_ship"))
    return (
        per_order.join(part, per_order.first_partkey == part.p_partkey, "left")
        .join(cust, per_order.o_custkey == cust.c_custkey, "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            "o_orderkey",
            F.col("o_orderkey").cast("string").alias("external_id"),
            F.col("o_orderdate").alias("created_at"),
            _deadline(F.col("o_orderdate"), F.col("o_orderpriority")).alias("deadline"),
            done.alias("completed_at"),
            F.when(done.isNull(), "Open").otherwise("Closed").alias("current_status"),
            F.when(done.isNull(), F.lit(None).cast("string"))
            .when(F.col("o_orderstatus") == "F", "Case Resolved")
            .otherwise("Case Noted")
            .alias("closure_reason"),
            F.col("r_name").alias("source"),
            F.col("c_mktsegment").alias("subject"),
            F.col("o_orderpriority").alias("reason"),
            F.col("p_brand").alias("type"),
            F.col("n_name").alias("neighborhood"),
            F.lit(None).cast("string").alias("department"),
            *[F.coalesce(f"code_{c}", F.lit(C.MISSING_CODE)).alias(f"code_{c}") for c in ("source", "subject", "type", "neighborhood")],
            _code(F.col("o_orderpriority")).alias("code_reason"),
        )
    )


def _code(c):
    return F.when(X.blank_to_null(c).isNull(), F.lit(C.MISSING_CODE)).otherwise(X.canonical_code_rule(c))


def process_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``processes`` table with canonical codes (every raw value is in the catalog)."""
    return _cases(spark, sf_dir).select(
        "o_orderkey", "external_id", "created_at", "deadline", "completed_at", "current_status",
        "closure_reason",
        *[F.col(f"code_{c}").alias(c) for c in C.CATEGORICAL_FEATURES],
        F.col("code_type").alias("process_type"),
    )


def snapshot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening snapshots (P9 payload) with injected defects.

    * ``o_orderkey % 97 = 13`` -> the ``neighborhood`` key is absent (schema error)
    * ``o_orderkey % 89 = 7``  -> malformed JSON text (schema error)
    * ``o_orderkey % 83 = 5``  -> older feature schema version (filtered by F6)
    """
    pv = process_view(spark, sf_dir)
    payload = F.to_json(
        F.struct(
            X.iso_text("created_at").alias("created_at"),
            X.iso_text("deadline").alias("deadline"),
            F.col("external_id"),
            *[F.col(c) for c in C.CATEGORICAL_FEATURES],
        ),
        {"ignoreNullFields": "false"},
    )
    no_hood = F.to_json(
        F.struct(
            X.iso_text("created_at").alias("created_at"),
            X.iso_text("deadline").alias("deadline"),
            F.col("external_id"),
            *[F.col(c) for c in C.CATEGORICAL_FEATURES if c != "neighborhood"],
        ),
        {"ignoreNullFields": "false"},
    )
    k = F.col("o_orderkey")
    return pv.select(
        "external_id",
        F.lit(C.SNAPSHOT_TYPE).alias("snapshot_type"),
        F.when(k % 83 == 5, F.lit("opening-v0")).otherwise(F.lit(C.FEATURE_SCHEMA_VERSION)).alias(
            "feature_schema_version"
        ),
        F.when(k % 97 == 13, no_hood).when(k % 89 == 7, F.lit("{bad json")).otherwise(payload).alias("input_json"),
    )


def catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical catalog (column, raw, code, version) built from the dimension values.

    Size is the number of distinct labels (tens of rows); callers still
    check the size before broadcasting.  Stored once like a config table.
    """
    return materialized(spark, sf_dir, "catalog", _catalog_view)


def _catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    def labels(table, col, name):
        return read_table(spark, sf_dir, table).select(F.col(col).alias("raw")).distinct().select(
            F.lit(name).alias("column"), "raw"
        )

    parts = [
        labels("region", "r_name", "source"),
        labels("customer", "c_mktsegment", "subject"),
        labels("orders", "o_orderpriority", "reason"),
        labels("part", "p_brand", "type"),
        labels("nation", "n_name", "neighborhood"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        "column", "raw", X.canonical_code_rule("raw").alias("code"), F.lit(C.CANONICAL_MAPPING_VERSION).alias("version")
    )


def prediction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prediction_runs`` derived from ``events`` (one prediction per event).

    process_id = user_id (an order key that exists at every scale),
    bundle 2 for 'signup' else 1, 'purchase' = simulation context,
    'error' = failed run; p = value / 500; no SLA when user_id % 7 = 0.
    """
    ev = read_table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    p = F.when(~failed, F.round(F.col("value") / 500.0, 6))
    score = X.risk_score(p)
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("process_id"),
        F.col("user_id").alias("snapshot_id"),
        F.when(F.col("event_type") == "signup", 2).otherwise(1).cast("bigint").alias("model_bundle_id"),
        F.when(F.col("event_type") == "signup", "v2").otherwise("v1").alias("model_version"),
        F.when(F.col("event_type") == "purchase", "simulation").otherwise("opening").alias("prediction_context"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        p.alias("delay_probability"),
        score.alias("risk_score"),
        X.risk_level(score).alias("risk_level"),
        F.when(~failed & (F.col("user_id") % 7 != 0), (p >= C.DEFAULT_THRESHOLD).cast("int")).alias(
            "predicted_is_delayed"
        ),
        F.when(~failed, F.col("value")).alias("predicted_hours"),
        F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.col("props")), 256).alias("input_fingerprint"),
        F.col("ts").alias("predicted_at"),
    )


def scored_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic scores with labels for the metric operators.

    y = P14 target; p = a 2-decimal score mixing y with a price-derived
    fraction (ties on purpose); yhat = SLA hours (or 720) vs y_hours = P15.
    """
    from docket.operators.dataset import case_targets

    pv = case_targets(process_view(spark, sf_dir), C.TEST_SPLITS, C.TEST_CUTOFF)
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    # integer arithmetic only, so every engine yields the same double
    f = F.floor(F.col("o_totalprice") * 7) % 100
    num = F.lit(30) * F.coalesce(F.col("is_delayed"), F.lit(0)) + F.floor(f * 7 / 10)
    return pv.join(o.hint("merge"), "o_orderkey").select(
        "external_id",
        "split",
        F.col("created_at"),
        F.col("is_delayed").alias("y"),
        (num.cast("double") / F.lit(100.0)).alias("p"),
        F.col("total_duration_hours").alias("y_hours"),
        F.coalesce(F.col("sla_duration_hours"), F.lit(720.0)).alias("yhat_hours"),
    )


# --- ingest deliveries -----------------------------------------------------------------------
def _fmt(c):
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def _other_nation(c):
    return F.when(c == "FRANCE", F.lit("GERMANY")).otherwise(F.lit("FRANCE"))


def delivery(spark: SparkSession, sf_dir: str, batch: int) -> DataFrame:
    """Source rows (all strings) as two deliveries of every order.

    batch 1 = cases as opened (no outcome); batch 2 = the same cases with
    outcomes.  Injected, by key rule (every order is still delivered):
    batch 1: k%101=3 blank id, k%103=4 bad open_dt, k%107=5 blank open_dt,
    k%109=6 impossible SLA date; both: k%37=7 unknown source, k%41=8 unknown
    department; batch 2: k%113=7 bad closed_dt, k%43=9 changed neighborhood
    (conflict), k%47=10 exact repeat row (skip), k%53=11 repeat with a changed
    neighborhood (conflict).  Row numbers: batch 1 k+1, batch 2 2k+1 / 2k+2.
    """
    raw = process_raw(spark, sf_dir)
    k = F.col("o_orderkey")
    hood = F.coalesce(F.col("neighborhood"), F.lit(""))
    common = {
        "source": F.when(k % 37 == 7, F.lit("Walk-in Kiosk")).otherwise(F.coalesce(F.col("source"), F.lit(""))),
        "subject": F.coalesce(F.col("subject"), F.lit("")),
        "reason": F.coalesce(F.col("reason"), F.lit("")),
        "type": F.coalesce(F.col("type"), F.lit("")),
        "department": F.when(k % 41 == 8, F.lit("Public Works")).otherwise(F.lit("")),
    }
    if batch == 1:
        rows = raw.select(
            "o_orderkey",
            F.when(k % 101 == 3, F.lit("")).otherwise(F.col("external_id")).alias("case_enquiry_id"),
            F.when(k % 103 == 4, F.lit("not-a-date")).when(k % 107 == 5, F.lit("")).otherwise(_fmt(F.col("created_at")))
            .alias("open_dt"),
            F.lit("").alias("closed_dt"),
            F.when(k % 109 == 6, F.lit("2024-02-30")).otherwise(_fmt(F.col("deadline"))).alias("sla_target_dt"),
            F.lit("Open").alias("case_status"),
            *[v.alias(c) for c, v in common.items() if c in ("source", "subject", "reason", "type")],
            hood.alias("neighborhood"), common["department"].alias("department"),
            F.lit("").alias("closure_reason"),
            F.lit("batch1.csv").alias("_file"), F.lit(1).alias("_file_seq"), (k + 1).alias("_row"))
        return rows
    main_hood = F.when(k % 43 == 9, _other_nation(hood)).otherwise(hood)
    base = raw.select(
        "o_orderkey",
        F.col("external_id").alias("case_enquiry_id"),
        _fmt(F.col("created_at")).alias("open_dt"),
        F.when(k % 113 == 7, F.lit("yesterday")).otherwise(_fmt(F.col("completed_at"))).alias("closed_dt"),
        _fmt(F.col("deadline")).alias("sla_target_dt"),
        F.col("current_status").alias("case_status"),
        *[v.alias(c) for c, v in common.items() if c in ("source", "subject", "reason", "type")],
        main_hood.alias("neighborhood"), common["department"].alias("department"),
        F.coalesce(F.col("closure_reason"), F.lit("")).alias("closure_reason"),
        hood.alias("_orig_hood"))
    copies = F.when(k % 47 == 10, F.array(F.lit(0), F.lit(1))).when(k % 53 == 11, F.array(F.lit(0), F.lit(2))).otherwise(
        F.array(F.lit(0)))
    out = base.withColumn("_copy", F.explode(copies))
    return out.select(
        "o_orderkey", "case_enquiry_id", "open_dt", "closed_dt", "sla_target_dt", "case_status", "source", "subject",
        "reason", "type",
        F.when(F.col("_copy") == 2, _other_nation(F.col("_orig_hood"))).otherwise(F.col("neighborhood")).alias(
            "neighborhood"),
        "department", "closure_reason",
        F.lit("batch2.csv").alias("_file"), F.lit(2).alias("_file_seq"),
        (F.col("o_orderkey") * 2 + 1 + F.when(F.col("_copy") > 0, 1).otherwise(0)).alias("_row"))


STATE_SCHEMA = ("external_id string, created_at timestamp_ntz, deadline timestamp_ntz, completed_at timestamp_ntz, "
                "current_status string, closure_reason string, process_type string, e_opening_fp string, "
                "e_row_fp string, e_mapping_version string, last_import string")


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def ingest_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog for the deliveries: the dimension labels (department has none)."""
    return catalog_view(spark, sf_dir)
