"""Leakage-safe dataset: features from the opening snapshot, targets from outcomes.

Operators (SURVEY rows): P10-P16, F5, F6, J1, A15, A16, A17, W8.
All are DataFrame -> DataFrame; no collect, no Python UDF.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket import config as C
from docket.functions import exprs as X

Splits = Sequence[tuple[str, _dt.datetime, _dt.datetime]]

SNAPSHOT_JSON_SCHEMA = T.StructType(
    [T.StructField(k, T.StringType()) for k in ["created_at", "deadline", "external_id", *C.CATEGORICAL_FEATURES]]
)


def case_targets(processes: DataFrame, splits: Splits = C.REFERENCE_SPLITS,
                 cutoff: _dt.datetime = C.REFERENCE_CUTOFF) -> DataFrame:
    """Add P11/P12 features and P14/P15/P16 targets straight from process rows."""
    cal = X.calendar_features("created_at")
    return processes.withColumns(
        {
            **cal,
            "sla_duration_hours": X.sla_hours("created_at", "deadline"),
            "is_delayed": X.is_delayed("completed_at", "deadline", cutoff),
            "total_duration_hours": X.duration_hours("created_at", "completed_at"),
            "split": X.split_label("created_at", splits),
        }
    )


def opening_snapshots(snapshots: DataFrame, schema_version: str = C.FEATURE_SCHEMA_VERSION,
                      snapshot_type: str = C.SNAPSHOT_TYPE) -> DataFrame:
    """current-schema opening snapshots only (pushes down to the scan)."""
    return snapshots.where((F.col("snapshot_type") == snapshot_type) & (F.col("feature_schema_version") == schema_version))


def evaluated_once(df: DataFrame, cols: dict) -> DataFrame:
    """``df`` with ``cols`` added (or replaced); each is computed once a row, however often it is used later.

    The columns leave a generator over one struct, into which neither later filters nor projections are
    pushed: a projection would put the whole expression wherever a filter or field access names the column.
    """
    kept = [c for c in df.columns if c not in cols]
    out = df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))
    order = [*df.columns, *[c for c in cols if c not in df.columns]]
    return out if out.columns == order else out.select(*[F.col(f"`{c}`") for c in order])


def _snapshot_fields(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` with ``_keys`` and every field of ``input_json`` as a column ``_s_*``, parsed once a row.

    The fields leave the generator as plain columns: Spark's pruning of nested columns may lose a struct's fields
    that are read beyond two generators (the child columns a generator drops are known to it by number only).
    """
    read = snapshots.select("*", F.inline(F.array(F.from_json("input_json", SNAPSHOT_JSON_SCHEMA))).alias(*[f"_s_{f}" for f in SNAPSHOT_JSON_SCHEMA.names]))
    return evaluated_once(read, {"_keys": F.json_object_keys("input_json"), "_tc": X.strip("_s_created_at"), "_td": X.strip("_s_deadline")})


def parse_snapshot(snapshots: DataFrame, required: Sequence[str] = C.SNAPSHOT_REQUIRED_KEYS) -> DataFrame:
    """P10: parse ``input_json`` and list missing required keys.

    A key present with a null value counts as present; malformed JSON gives
    NULL keys and is a schema error.  Adds ``snap`` (struct), ``missing_keys``
    and ``schema_error`` (NULL when the row is usable), ``snap_created`` and ``snap_deadline`` (parsed),
    and the categories as ``snap_*``.
    """
    kept = [c for c in snapshots.columns if c not in ("snap", "missing_keys", "schema_error")]
    read = _snapshot_fields(snapshots.select(*[F.col(f"`{c}`") for c in kept]))
    keys = F.col("_keys")
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(keys, F.array().cast("array<string>")))
    read = evaluated_once(read, {"missing_keys": missing, "_created": X.parse_stripped("_tc"), "_deadline": X.parse_stripped("_td")})
    error = (
        F.when(keys.isNull(), F.lit("malformed input_json"))
        .when(F.size("missing_keys") > 0, F.concat(F.lit("missing keys: "), F.array_join("missing_keys", ",")))
        .when(F.col("_created").isNull(), F.lit("created_at missing or unparseable"))
    )
    # nobody here reads ``snap``: who does parses again
    return read.select(*[F.col(f"`{c}`") for c in kept], F.from_json("input_json", SNAPSHOT_JSON_SCHEMA).alias("snap"), "missing_keys", error.alias("schema_error"),
                       F.col("_created").alias("snap_created"), F.col("_deadline").alias("snap_deadline"),
                       *[F.col(f"_s_{c}").alias(f"snap_{c}") for c in C.CATEGORICAL_FEATURES])


def snapshot_features(parsed: DataFrame) -> DataFrame:
    """P11-P13 from the parsed snapshot (the only feature source)."""
    created, deadline = F.col("snap_created"), F.col("snap_deadline")
    cal = X.calendar_features(created)
    return parsed.withColumns(
        {
            **{c: F.col(f"snap_{c}") for c in C.CATEGORICAL_FEATURES},
            **cal,
            "sla_duration_hours": X.sla_hours(created, deadline),
        }
    )


def scoring_features(snapshots: DataFrame, snapshot_type: str = C.SNAPSHOT_TYPE) -> DataFrame:
    """P10-P13 as scoring sees them: every opening snapshot, whatever its schema version.

    An absent category key reads as ``missing``; only malformed JSON or an unusable created_at is an
    error.  Output: external_id, 10 features, ``has_sla`` (1 when a deadline
    text is there, also for a negative SLA), ``feature_error`` (NULL when usable).
    """
    s = snapshots.where(F.col("snapshot_type") == snapshot_type).select("external_id", "input_json")
    s = _snapshot_fields(s)
    s = evaluated_once(s, {"_created": X.parse_stripped("_tc"), "_deadline": X.parse_stripped("_td")})
    created, deadline = F.col("_created"), F.col("_deadline")
    error = (F.when(F.col("_keys").isNull(), F.lit("malformed input_json"))
             .when(created.isNull(), F.lit("created_at missing or unparseable")))
    s = s.withColumn("feature_error", error)
    ok = F.col("feature_error").isNull()
    raw = {
        **{c: F.when(F.array_contains("_keys", c), F.col(f"_s_{c}")).otherwise(F.lit(C.MISSING_CODE))
           for c in C.CATEGORICAL_FEATURES},
        **X.calendar_features(created),
        "sla_duration_hours": X.sla_hours(created, deadline),
    }
    return s.select("external_id", *[F.when(ok, raw[c]).alias(c) for c in C.ALL_FEATURES],
                    F.when(ok, (~F.coalesce(F.col("_td") == "", F.lit(True))).cast("int")).alias("has_sla"), "feature_error")


def build_dataset(snapshots: DataFrame, processes: DataFrame, splits: Splits = C.REFERENCE_SPLITS,
                  cutoff: _dt.datetime = C.REFERENCE_CUTOFF,
                  schema_version: str = C.FEATURE_SCHEMA_VERSION) -> DataFrame:
    """F6 + J1 + P10-P16: one row per current opening snapshot.

    Output: external_id, created_at, split, 10 features, is_delayed,
    total_duration_hours, schema_error.  Rows with a schema error keep NULL
    features and targets so A16 can count them; cohorts filter them out.
    Join is on ``external_id`` (both sides one row per key and as long as the case table, so neither is
    broadcast, however well the stored table is compressed).
    """
    snaps = parse_snapshot(opening_snapshots(snapshots, schema_version).select("external_id", "input_json"))
    feats = snapshot_features(snaps)
    proc = processes.select("external_id", "created_at", "deadline", "completed_at")
    joined = feats.join(proc.hint("merge"), "external_id", "inner")
    ok = F.col("schema_error").isNull()
    cols = [
        "external_id", "created_at", X.split_label("created_at", splits).alias("split"),
        *[F.when(ok, F.col(c)).alias(c) for c in C.ALL_FEATURES],
        F.when(ok, X.is_delayed("completed_at", "deadline", cutoff)).alias("is_delayed"),
        F.when(ok, X.duration_hours("created_at", "completed_at")).alias("total_duration_hours"),
        "schema_error",
    ]
    return joined.select(*cols)


def cohort(dataset: DataFrame, target: str) -> DataFrame:
    """usable rows with a target and a split."""
    return dataset.where(F.col("schema_error").isNull() & F.col(target).isNotNull() & F.col("split").isNotNull())


def split_summary(dataset: DataFrame, sealed: Sequence[str] = C.SEALED_SPLITS) -> DataFrame:
    """Rows and date range per (cohort, split); sealed splits expose only these."""
    # one pass: each row is counted in every cohort it belongs to
    ok = F.col("schema_error").isNull() & F.col("split").isNotNull()
    member = F.filter(F.array(F.when(ok & F.col("is_delayed").isNotNull(), F.lit("classification")),
                              F.when(ok & F.col("total_duration_hours").isNotNull(), F.lit("regression"))),
                      lambda x: x.isNotNull())
    out = (dataset.select("split", "created_at", F.explode(member).alias("cohort"))
           .groupBy("cohort", "split")
           .agg(F.count(F.lit(1)).alias("row_count"), F.min("created_at").alias("min_created_at"),
                F.max("created_at").alias("max_created_at")))
    return out.withColumn("sealed", F.col("split").isin(list(sealed)).cast("int")).select(
        "cohort", "split", "sealed", "row_count", "min_created_at", "max_created_at"
    )


def build_accounting(snapshots: DataFrame, dataset: DataFrame) -> DataFrame:
    """Total current snapshots joined, exclusions per cohort, unassigned split, schema errors."""
    ok = F.col("schema_error").isNull()
    return dataset.agg(
        F.count(F.lit(1)).alias("total_snapshots"),
        F.sum(F.when(ok & F.col("is_delayed").isNull(), 1).otherwise(0)).cast("bigint").alias("classification_excluded"),
        F.sum(F.when(ok & F.col("total_duration_hours").isNull(), 1).otherwise(0)).cast("bigint").alias(
            "regression_excluded"),
        F.sum(F.when(ok & F.col("split").isNull(), 1).otherwise(0)).cast("bigint").alias("unassigned_split"),
        F.sum(F.when(~ok, 1).otherwise(0)).cast("bigint").alias("schema_errors"),
    )


def actual_kpis(processes: DataFrame) -> DataFrame:
    """A3: completed, on-time, delayed, delay rate over all processes (one scan)."""
    done = F.col("completed_at").isNotNull()
    sla = F.col("deadline").isNotNull()
    agg = processes.agg(
        F.sum(F.when(done, 1).otherwise(0)).cast("bigint").alias("total_completed"),
        F.sum(F.when(done & sla & (F.col("completed_at") <= F.col("deadline")), 1).otherwise(0)).cast("bigint").alias(
            "on_time"),
        F.sum(F.when(done & sla & (F.col("completed_at") > F.col("deadline")), 1).otherwise(0)).cast("bigint").alias(
            "actually_delayed"),
    )
    return agg.select(
        F.coalesce("total_completed", F.lit(0)).cast("bigint").alias("total_completed"),
        F.coalesce("on_time", F.lit(0)).cast("bigint").alias("on_time"),
        F.coalesce("actually_delayed", F.lit(0)).cast("bigint").alias("actually_delayed"),
        (F.coalesce("actually_delayed", F.lit(0))
         / F.greatest(F.lit(1), F.coalesce("on_time", F.lit(0)) + F.coalesce("actually_delayed", F.lit(0)))).alias(
            "actual_delay_rate"),
    )


def dataset_fingerprint(dataset: DataFrame, target: str, cutoff: _dt.datetime,
                        schema_version: str = C.FEATURE_SCHEMA_VERSION,
                        mapping_version: str = C.CANONICAL_MAPPING_VERSION) -> DataFrame:
    """Order-independent SHA-256 over features + target + versions + cutoff + count.

    Each row becomes one text of length-prefixed values (so that a NULL and a
    shifted value differ), whose first 15 SHA-256 hex digits are summed exactly as
    decimal(38,0) (a sum, not xor, so duplicate rows do not cancel) and
    combined with the metadata text.  One partial+final aggregate;
    insensitive to row order and partitioning.
    """
    cols = ["external_id", *C.ALL_FEATURES, target]
    fractional = ("sla_duration_hours", "total_duration_hours")
    text = [F.round(F.col(c) * 3.6e9).cast("bigint").cast("string") if c in fractional else F.col(c).cast("string") for c in cols]
    row = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])
    h = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    meta = f"{schema_version}|{mapping_version}|{cutoff.isoformat()}|{','.join(C.ALL_FEATURES)}|{target}"
    agg = cohort(dataset, target).agg(F.count(F.lit(1)).alias("row_count"), F.sum(h).alias("hash_sum"))
    return agg.select(
        F.lit(target).alias("target"),
        "row_count",
        F.sha2(F.concat_ws("|", F.lit(meta), F.col("row_count").cast("string"),
                           F.coalesce(F.col("hash_sum").cast("string"), F.lit("0"))), 256).alias("fingerprint"),
    )
