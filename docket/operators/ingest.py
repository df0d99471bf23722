"""Ingest: validate, canonicalise, fingerprint, decide, apply.

Input rows carry the source columns as strings plus ``_file`` (import run
name), ``_file_seq`` (file order within a batch) and ``_row`` (1-based data
row).  The existing state is the ``processes`` table with its opening
fingerprint.  One bad row never fails the file: errors become issue rows.

Scale notes
* The catalog join is left to the optimizer, which sees the real size at run
  time (a configuration table is broadcast, a large one is shuffled).
* A key with very many rows does not need one task: its first row comes from
  a partial aggregate and is stored with the key's state, the join of rows and
  keys is a plain two-sided shuffle that the optimizer splits when skewed, and
  the "previous accepted fingerprint" is a lag computed through a global row
  index and a self-join on that unique index (:func:`index_lag`).
* Parsed, coded and fingerprinted rows, and rows with their key's state, are each written
  once per import, as columns; only rows of keys that repeat are sorted.  Fingerprints are stored and
  exchanged as 32 bytes (:func:`exprs.pack_hex`), and a table goes as soon as the next one is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket import config as C
from docket.functions import exprs as X
from docket.operators.dataset import evaluated_once
from docket.operators.ordering import global_index
from docket.session import drop_shuffles, drop_stored, stored

# --- F1 -----------------------------------------------------------------------------
def missing_required_columns(headers: DataFrame, required: Sequence[str] = C.REQUIRED_COLUMNS) -> DataFrame:
    """per file, required columns absent from its (stripped) header.

    ``headers``: (_file, columns array<string>).  Output: (_file, missing array).
    """
    stripped = F.transform(F.col("columns"), lambda c: X.strip(c))
    return headers.select("_file", F.array_except(F.array(*[F.lit(c) for c in required]), stripped).alias("missing"))


def failed_file_issues(missing: DataFrame) -> DataFrame:
    """One MISSING_REQUIRED_COLUMN issue per absent column of a failed file."""
    return missing.where(F.size("missing") > 0).select(
        F.col("_file").alias("import_run"), F.lit(None).cast("long").alias("row_number"),
        F.explode("missing").alias("column_name")).select(
        "import_run", "row_number", "column_name", F.lit("MISSING_REQUIRED_COLUMN").alias("issue_code"),
        F.lit("error").alias("severity"),
        F.concat(F.lit("required column missing: "), F.col("column_name")).alias("issue_message"))


# --- F2 / P1 / P2 / P3 -------------------------------------------------------------------
def _src(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def validate_rows(rows: DataFrame) -> DataFrame:
    """F2 + P1 + P2: parse and find the first error of each row.

    Order: id blank -> open_dt invalid -> open_dt blank -> sla invalid ->
    closed invalid.  Adds external_id, created_at, deadline, completed_at,
    current_status, closure_reason, error_code, error_field.
    """
    # texts are stripped once, then parsed from the stripped ones
    texts = evaluated_once(rows, {k: X.strip(_src(rows, c)) for k, c in (
        ("_open", "open_dt"), ("_sla", "sla_target_dt"), ("_closed", "closed_dt"),
        ("_id", "case_enquiry_id"), ("_status", "case_status"), ("_reason", "closure_reason"))})
    parsed = evaluated_once(texts, {"created_at": X.parse_stripped("_open"), "deadline": X.parse_stripped("_sla"), "completed_at": X.parse_stripped("_closed")})
    parsed = parsed.withColumns({k: F.when(F.col(t) != "", F.col(t)) for k, t in (("external_id", "_id"), ("current_status", "_status"), ("closure_reason", "_reason"))})
    blank = lambda t: F.coalesce(F.col(t) == "", F.lit(True))
    bad = lambda t, at: ~blank(t) & F.col(at).isNull()
    err = (
        F.when(F.col("external_id").isNull(), F.struct(F.lit("REQUIRED_FIELD_MISSING").alias("code"), F.lit("case_enquiry_id").alias("f")))
        .when(bad("_open", "created_at"), F.struct(F.lit("INVALID_DATE").alias("code"), F.lit("open_dt").alias("f")))
        .when(blank("_open"), F.struct(F.lit("REQUIRED_FIELD_MISSING").alias("code"), F.lit("open_dt").alias("f")))
        .when(bad("_sla", "deadline"), F.struct(F.lit("INVALID_DATE").alias("code"), F.lit("sla_target_dt").alias("f")))
        .when(bad("_closed", "completed_at"), F.struct(F.lit("INVALID_DATE").alias("code"), F.lit("closed_dt").alias("f")))
    )
    return parsed.withColumn("_err", err).drop("_open", "_sla", "_closed", "_id", "_status", "_reason").withColumns({"error_code": F.col("_err.code"), "error_field": F.col("_err.f")}).drop("_err")


def canonicalize(rows: DataFrame, catalog: DataFrame, columns: Sequence[str] = C.CATEGORICAL_COLUMNS) -> DataFrame:
    """Per column, blank -> 'missing'; exact trimmed match -> code; else 'unknown'.

    Adds ``<col>_code`` and ``<col>_unknown`` (1 when non-blank and not in the
    catalog).  Case-sensitive; never invents codes.
    """
    cat = catalog.select("column", F.col("raw").alias("_raw"), F.col("code").alias("_code"))
    out = rows
    for c in columns:
        trimmed = X.strip(_src(out, c))
        out = out.withColumn("_t", trimmed)
        m = cat.where(F.col("column") == c).select(F.col("_raw").alias(f"_raw_{c}"), F.col("_code").alias(f"_code_{c}"))
        out = out.join(m, out["_t"] == m[f"_raw_{c}"], "left")
        blank = F.col("_t").isNull() | (F.col("_t") == "")
        out = out.withColumns({
            f"{c}_code": F.when(blank, F.lit(C.MISSING_CODE)).otherwise(F.coalesce(F.col(f"_code_{c}"),
                                                                                     F.lit(C.UNKNOWN_CODE))),
            f"{c}_unknown": (~blank & F.col(f"_code_{c}").isNull()).cast("int"),
        }).drop("_t", f"_raw_{c}", f"_code_{c}")
    return out


def add_fingerprints(rows: DataFrame) -> DataFrame:
    """Opening and row fingerprints (sorted compact JSON, SHA-256)."""
    opening_texts = {"external_id": "external_id", **{c: f"{c}_code" for c in C.CATEGORICAL_FEATURES}}
    outcome_texts = {"current_status": "current_status", "closure_reason": "closure_reason"}
    named = {**opening_texts, **outcome_texts}
    rows = evaluated_once(rows, {f"_st_{k}": X.strip(F.col(c).cast("string")) for k, c in named.items()})
    text = lambda k: X.norm_stripped(F.col(named[k]), F.col(f"_st_{k}"))
    opening = {**{k: text(k) for k in opening_texts}, **{k: X.norm_value(k, True) for k in ("created_at", "deadline")}}
    outcome = {**{k: text(k) for k in outcome_texts}, "completed_at": X.norm_value("completed_at", True)}
    combined = {**{f"opening__{k}": v for k, v in opening.items()}, **{f"outcome__{k}": v for k, v in outcome.items()}}
    # every field is normalised once for both fingerprints
    texts = evaluated_once(rows, {f"_fp_{k}": v for k, v in combined.items()})
    pick = lambda prefix: {k: F.col(f"_fp_{prefix}{k}") for k in (opening if prefix else combined)}
    return texts.withColumns({"opening_fp": X.fingerprint(pick("opening__")), "row_fp": X.fingerprint(pick(""))}).drop(*[f"_fp_{k}" for k in combined], *[f"_st_{k}" for k in named])


def snapshot_payload() -> F.Column:
    """The opening snapshot JSON (keys sorted; deadline null kept)."""
    return F.to_json(F.struct(
        X.iso_text("created_at").alias("created_at"), X.iso_text("deadline").alias("deadline"),
        F.col("external_id"), *[F.col(f"{c}_code").alias(c) for c in sorted(C.CATEGORICAL_FEATURES)]),
        {"ignoreNullFields": "false"})


# --- W4 ---------------------------------------------------------------------------------
def index_lag(df: DataFrame, key: str, order_cols: Sequence[str], value_col: str, out_col: str) -> DataFrame:
    """Previous ``value_col`` within ``key`` in ``order_cols`` order, skew-safe.

    A global index over (key, order) plus a self-join on ``index - 1``: the
    join key is unique, so no key - however hot - concentrates in a task.
    """
    idx = global_index(df, [key, *order_cols], "_li")
    prev = idx.select((F.col("_li") + 1).alias("_li"), F.col(key).alias("_pk"), F.col(value_col).alias("_pv"))
    j = idx.join(prev, "_li", "left")
    return j.withColumn(out_col, F.when(F.col("_pk") == F.col(key), F.col("_pv"))).drop("_li", "_pk", "_pv")


def decide(valid: DataFrame, state: DataFrame, mapping_version: str = C.CANONICAL_MAPPING_VERSION) -> DataFrame:
    """Insert / skip / update / CANONICAL_MAPPING_MISMATCH / OPENING_DATA_CONFLICT per valid row.

    ``valid``: rows without a validation error, with external_id, opening_fp,
    row_fp, _file_seq, _row.  ``state``: external_id, e_opening_fp (NULL if the
    stored snapshot is missing), e_row_fp, e_mapping_version.
    Rule (file order): base = stored opening fp if the key exists, else the
    key's first row; prev = last row fp among earlier rows with the base
    opening fp, else the stored row fp.
    """
    return _unpacked(_decide(_packed(valid), state, mapping_version)[0])


_FINGERPRINTS = ("opening_fp", "row_fp")


def _packed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: X.pack_hex(c) for c in _FINGERPRINTS})


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: X.unpack_hex(c) for c in _FINGERPRINTS})


def _decide(valid: DataFrame, state: DataFrame, mapping_version: str) -> tuple[DataFrame, list[DataFrame]]:
    """:func:`decide` on packed fingerprints, and the stored tables that the result reads.

    The opening fingerprint stays only with rows of keys that are not in the state: no other row can be inserted.
    """
    order = F.struct("_file_seq", "_row")
    first = valid.groupBy("external_id").agg(F.min_by("opening_fp", order).alias("_first_fp"),
                                             F.min(order).alias("_first_pos"),
                                             F.count(F.lit(1)).alias("_n_rows"))
    st = state.select("external_id", F.lit(1).alias("_exists"), X.pack_hex("e_opening_fp").alias("e_opening_fp"), X.pack_hex("e_row_fp").alias("e_row_fp"),
                      "e_mapping_version")
    # one stored row per key, so that the join with the rows has two plain shuffles
    # below it and a key with very many rows is split at run time
    base = F.when(F.col("_exists") == 1, F.col("e_opening_fp")).otherwise(F.col("_first_fp"))
    keys = stored(first.join(st, "external_id", "left").withColumn("_base", base).drop("_first_fp", "e_opening_fp"))
    del first, st
    drop_shuffles(valid.sparkSession)
    # what is compared with the key's state is compared here, so that no fingerprint but the row's own is stored again
    is_first = (F.col("_first_pos._file_seq") == F.col("_file_seq")) & (F.col("_first_pos._row") == F.col("_row"))
    j = stored(valid.join(keys, "external_id").withColumns({
        "_on_base": F.coalesce(F.col("opening_fp") == F.col("_base"), F.lit(False)), "_as_stored": F.coalesce(F.col("row_fp") == F.col("e_row_fp"), F.lit(False)),
        "_is_first": is_first, "_more": F.col("_n_rows") > 1,
    }).withColumn("opening_fp", F.when(F.col("_exists").isNull(), F.col("opening_fp"))).drop("_base", "e_row_fp", "_first_pos", "_n_rows"))
    drop_stored(keys)
    drop_shuffles(valid.sparkSession)
    held = [j]
    # only keys delivered more than once can have an earlier row in this batch: rows of the others are not sorted
    # and not joined again; when none repeats (the usual delivery) the lag is skipped entirely
    none = F.lit(None).cast("binary").alias("_prev_in_batch")
    if j.where("_more").limit(1).count():
        at, more = ["external_id", "_file_seq", "_row"], F.col("_more")
        lagged = index_lag(j.where(more & F.col("_on_base")).select(*at, "row_fp"), "external_id", at[1:], "row_fp", "_prev_in_batch").select(*at, "_prev_in_batch")
        held.append(stored(j.where(more).join(lagged, at, "left")))
        j = j.where(~more).select("*", none).unionByName(held[-1])
    else:
        j = j.select("*", none)
    prev = F.col("_prev_in_batch")
    decision = (
        F.when(F.col("_exists").isNull() & F.col("_is_first"), F.lit("insert"))
        .when(F.col("e_mapping_version").isNotNull() & (F.col("e_mapping_version") != mapping_version),
              F.lit("CANONICAL_MAPPING_MISMATCH"))
        .when(F.when(prev.isNull(), F.col("_as_stored")).otherwise(F.coalesce(F.col("row_fp") == prev, F.lit(False))), F.lit("skip"))
        .when(F.col("_on_base"), F.lit("update"))
        .otherwise(F.lit("OPENING_DATA_CONFLICT"))
    )
    return j.withColumn("decision", decision).drop("_exists", "_on_base", "_as_stored", "_is_first", "_more", "_prev_in_batch"), held


# --- W5 / S7 -------------------------------------------------------------------------------
def apply_outcomes(state: DataFrame, decided: DataFrame, run_version: str = C.CANONICAL_MAPPING_VERSION) -> DataFrame:
    """New processes state = unchanged rows + updated rows + inserted rows.

    The last accepted row (insert/update) of a key in file order gives the
    outcome fields (partial aggregate, skew-safe); opening fields of an
    existing process never change.  ``state`` columns: external_id,
    created_at, deadline, completed_at, current_status, closure_reason,
    process_type, e_opening_fp, e_row_fp, e_mapping_version, last_import.
    """
    return _apply(state, _packed(decided), run_version)


def _apply(state: DataFrame, decided: DataFrame, run_version: str) -> DataFrame:
    """:func:`apply_outcomes` of rows with packed fingerprints."""
    acc = decided.where(F.col("decision").isin("insert", "update"))
    order = F.struct("_file_seq", "_row")
    last = acc.groupBy("external_id").agg(
        F.max_by(F.struct("completed_at", "current_status", "closure_reason", "row_fp", "_file"), order).alias("o"),
        F.min_by(F.struct("created_at", "deadline", F.col("type_code").alias("process_type"), "opening_fp"),
                 order).alias("ins"),
        F.max(F.when(F.col("decision") == "insert", 1).otherwise(0)).alias("_ins"))
    upd = last.select(
        "external_id",
        F.when(F.col("_ins") == 1, F.col("ins.created_at")).alias("n_created_at"),
        F.when(F.col("_ins") == 1, F.col("ins.deadline")).alias("n_deadline"),
        F.when(F.col("_ins") == 1, F.col("ins.process_type")).alias("n_process_type"),
        F.when(F.col("_ins") == 1, X.unpack_hex("ins.opening_fp")).alias("n_opening_fp"),
        F.col("o.completed_at").alias("n_completed_at"), F.col("o.current_status").alias("n_current_status"),
        F.col("o.closure_reason").alias("n_closure_reason"), X.unpack_hex("o.row_fp").alias("n_row_fp"),
        F.col("o._file").alias("n_last_import"), F.lit(1).alias("_touched"))
    full = state.withColumn("_stored", F.lit(1)).join(upd, "external_id", "full_outer")
    t = F.col("_touched") == 1
    return full.select(
        "external_id",
        F.coalesce("created_at", "n_created_at").alias("created_at"),
        F.when(F.col("_stored") == 1, F.col("deadline")).otherwise(F.col("n_deadline")).alias("deadline"),
        F.when(t, F.col("n_completed_at")).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(t, F.col("n_current_status")).otherwise(F.col("current_status")).alias("current_status"),
        F.when(t, F.col("n_closure_reason")).otherwise(F.col("closure_reason")).alias("closure_reason"),
        F.coalesce("process_type", "n_process_type").alias("process_type"),
        F.coalesce("e_opening_fp", "n_opening_fp").alias("e_opening_fp"),
        F.when(t, F.col("n_row_fp")).otherwise(F.col("e_row_fp")).alias("e_row_fp"),
        F.when(t, F.lit(run_version)).otherwise(F.col("e_mapping_version")).alias("e_mapping_version"),
        F.when(t, F.col("n_last_import")).otherwise(F.col("last_import")).alias("last_import"),
    )


def new_snapshots(decided: DataFrame) -> DataFrame:
    """P9 + S7: one immutable opening snapshot per inserted process."""
    return decided.where(F.col("decision") == "insert").select(
        "external_id", F.lit(C.SNAPSHOT_TYPE).alias("snapshot_type"), F.col("created_at").alias("snapshot_at"),
        F.lit(C.FEATURE_SCHEMA_VERSION).alias("feature_schema_version"), snapshot_payload().alias("input_json"),
        F.col("opening_fp").alias("input_fingerprint"), F.col("_file").alias("source_import"))


_STAGED = ["_file", "_file_seq", "_row", "external_id", "created_at", "deadline", "completed_at", "current_status", "closure_reason",
           "error_code", "error_field", *[f"{c}_{x}" for c in C.CATEGORICAL_COLUMNS for x in ("code", "unknown")], "opening_fp", "row_fp"]


# --- whole import ------------------------------------------------------------------------------
def run_import(rows: DataFrame, state: DataFrame, catalog: DataFrame,
               mapping_version: str = C.CANONICAL_MAPPING_VERSION) -> dict[str, DataFrame]:
    """Validate -> canonicalise -> fingerprint -> decide for a batch of delivery rows.

    Returns ``rows`` (every input row with its outcome), ``issues``,
    ``counts`` (A1, one row per import run) and ``state`` (W5 result), which all read the stored tables ``held``.
    """
    # staging: rows are parsed, coded and fingerprinted once and written to the checkpoint folder without
    # their source texts; the decision step and every output read them from there.  Categories of a row
    # with an error are not looked up, so it stays one row whatever the catalog holds.
    parsed = validate_rows(rows)
    fine = F.col("error_code").isNull()
    parsed = parsed.withColumns({c: F.when(fine, _src(parsed, c)) for c in C.CATEGORICAL_COLUMNS})
    v = stored(_packed(add_fingerprints(canonicalize(parsed, catalog))).select(*_STAGED))
    bad = stored(v.where(~fine).select("_file", "_file_seq", "_row", "external_id", "error_code", "error_field"))
    # rows with their key's state are stored by the decision step; rows, issues, counters, state and snapshots all read them
    packed, held = _decide(v.where(fine).drop("error_code", "error_field"), state, mapping_version)
    drop_stored(v)
    decided = _unpacked(packed)
    outcome = decided.select("_file", "_file_seq", "_row", "external_id", "decision",
                             F.lit(None).cast("string").alias("error_field")).unionByName(bad.withColumnRenamed("error_code", "decision"))
    issues = row_issues(bad, decided)
    counts = import_counts(outcome, issues)
    return {"rows": outcome, "issues": issues, "counts": counts, "decided": decided,
            "state": _apply(state, packed, mapping_version), "snapshots": new_snapshots(decided), "held": [bad, *held]}


_MESSAGES = {
    "REQUIRED_FIELD_MISSING": "required field is blank",
    "INVALID_DATE": "date could not be parsed",
    "UNKNOWN_CANONICAL_MAPPING": "value not in the canonical catalog",
    "CANONICAL_MAPPING_MISMATCH": "stored record uses another mapping version",
    "OPENING_DATA_CONFLICT": "opening data conflicts with the stored record",
}


def _msg(code_col: F.Column) -> F.Column:
    m = F.create_map(*[x for k, v in _MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.concat(F.lit("row "), F.col("_row").cast("string"), F.lit(": "), m[code_col])


def row_issues(validated: DataFrame, decided: DataFrame) -> DataFrame:
    """Issue rows (raw values never stored): F2 errors, F3 warnings, W4 errors."""
    errs = validated.where(F.col("error_code").isNotNull()).select(
        F.col("_file").alias("import_run"), F.col("_row").alias("row_number"), F.col("error_field").alias("column_name"),
        F.col("error_code").alias("issue_code"), F.lit("error").alias("severity"),
        _msg(F.col("error_code")).alias("issue_message"))
    warn = decided.select("_file", "_row", F.explode(F.filter(F.array(*[
        F.when(F.col(f"{c}_unknown") == 1, F.lit(c)) for c in C.CATEGORICAL_COLUMNS]), lambda x: x.isNotNull())
    ).alias("column_name")).select(
        F.col("_file").alias("import_run"), F.col("_row").alias("row_number"), "column_name",
        F.lit("UNKNOWN_CANONICAL_MAPPING").alias("issue_code"), F.lit("warning").alias("severity"),
        F.concat(F.lit("row "), F.col("_row").cast("string"), F.lit(": "),
                 F.lit(_MESSAGES["UNKNOWN_CANONICAL_MAPPING"])).alias("issue_message"))
    w4 = decided.where(F.col("decision").isin("CANONICAL_MAPPING_MISMATCH", "OPENING_DATA_CONFLICT")).select(
        F.col("_file").alias("import_run"), F.col("_row").alias("row_number"),
        F.lit(None).cast("string").alias("column_name"), F.col("decision").alias("issue_code"),
        F.lit("error").alias("severity"), _msg(F.col("decision")).alias("issue_message"))
    return errs.unionByName(warn).unionByName(w4)


def import_counts(outcome: DataFrame, issues: DataFrame) -> DataFrame:
    """A1: counters and final status per import run (one aggregate each, joined on the run)."""
    d = F.col("decision")
    c = outcome.groupBy("_file").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(F.when(d == "insert", 1).otherwise(0)).cast("bigint").alias("inserted_rows"),
        F.sum(F.when(d == "update", 1).otherwise(0)).cast("bigint").alias("updated_rows"),
        F.sum(F.when(d == "skip", 1).otherwise(0)).cast("bigint").alias("skipped_duplicate_rows"),
        F.sum(F.when(~d.isin("insert", "update", "skip"), 1).otherwise(0)).cast("bigint").alias("quarantined_rows"),
    ).withColumn("error_rows", F.col("quarantined_rows"))
    w = issues.where(F.col("severity") == "warning").groupBy(F.col("import_run").alias("_file")).agg(
        F.count(F.lit(1)).alias("warning_count"))
    j = c.join(w, "_file", "left").fillna(0, ["warning_count"])
    status = (F.when((F.col("error_rows") > 0) & (F.col("inserted_rows") + F.col("updated_rows") > 0),
                     F.lit("completed_with_issues"))
              .when(F.col("error_rows") > 0, F.lit("failed")).otherwise(F.lit("completed")))
    return j.select(F.col("_file").alias("import_run"), status.alias("status"), "total_rows", "inserted_rows",
                    "updated_rows", "skipped_duplicate_rows", "quarantined_rows", "error_rows", "warning_count",
                    (F.col("inserted_rows") + F.col("updated_rows")).alias("imported_rows"))


def skip_known_files(files: DataFrame, runs: DataFrame) -> DataFrame:
    """S6 + J4: files whose hash already has a successful run are duplicates (left anti for the rest).

    Returns ``files`` with ``duplicate`` 0/1; failed runs do not block.
    """
    ok = runs.where(F.col("status").isin(*C.SUCCESS_IMPORT_STATUSES)).select("file_hash").distinct().withColumn(
        "_known", F.lit(1))
    return files.join(ok, "file_hash", "left").withColumn("duplicate", F.coalesce("_known", F.lit(0))).drop("_known")
