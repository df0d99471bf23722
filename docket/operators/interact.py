"""Live evaluation, feedback, what-if and scoring reuse.

All set-based: one request table in, decisions/rejects out, no per-id loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket import config as C
from docket.functions import exprs as X
from docket.operators import metrics as M


def live_cases(processes: DataFrame, features: DataFrame, scores: DataFrame) -> DataFrame:
    """Closed SLA cases left-joined to their opening snapshot and score.

    ``features``: :func:`docket.operators.dataset.scoring_features`.
    ``outcome`` = skipped (no opening snapshot) / failed (snapshot unusable,
    scoring would fail) / ok.  A case without a score keeps p NULL, which
    :func:`live_evaluation` counts as a failure.  ``y`` = completed after deadline.
    All sides are as long as the case table, so none is broadcast, however well the stored table is compressed.
    """
    closed = processes.where(F.col("completed_at").isNotNull() & F.col("deadline").isNotNull()).select(
        "external_id", (F.col("completed_at") > F.col("deadline")).cast("int").alias("y"),
        F.year("completed_at").cast("string").alias("evaluated_at"))
    snap = features.select("external_id", F.lit(1).alias("_has"), F.col("feature_error").isNotNull().alias("_bad"))
    j = closed.join(snap.hint("merge"), "external_id", "left").join(scores.hint("merge"), "external_id", "left")
    outcome = F.when(F.col("_has").isNull(), "skipped").when(F.col("_bad"), "failed").otherwise("ok")
    return j.withColumn("outcome", outcome).drop("_has", "_bad")


def live_evaluation(live: DataFrame, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Counts of skipped / failed plus E1, E2, E5 on the scored closed cases.

    A missing probability is excluded and counted as a failure rather than
    read as 0.0 (quirk Q19).  Counts and the confusion matrix are one
    aggregate; the AUC (distinct-score prefix sums) is read as one scalar.
    """
    ok = (F.col("outcome") == "ok") & F.col("p").isNotNull()
    rk = M.ranking_metrics(live.where(ok), ["outcome"]).first()  # one row: group 'ok'
    roc = rk["roc_auc"] if rk is not None else None
    y, yp = F.col("y"), (F.col("p") >= F.lit(threshold)).cast("int")

    def cnt(c):
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")

    agg = live.agg(
        cnt(F.col("outcome") == "skipped").alias("skipped_no_snapshot"),
        cnt((F.col("outcome") == "failed") | ((F.col("outcome") == "ok") & F.col("p").isNull())).alias(
            "prediction_failures"),
        cnt(ok).alias("total_evaluated"),
        cnt(ok & (y == 0) & (yp == 0)).alias("tn"), cnt(ok & (y == 0) & (yp == 1)).alias("fp"),
        cnt(ok & (y == 1) & (yp == 0)).alias("fn"), cnt(ok & (y == 1) & (yp == 1)).alias("tp"),
        F.avg(F.when(ok, (F.col("p") - y) * (F.col("p") - y))).alias("brier"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(
        "skipped_no_snapshot", "prediction_failures", "total_evaluated", "tn", "fp", "fn", "tp",
        M._div(tp, tp + fp).alias("precision"), M._div(tp, tp + fn).alias("recall"),
        M._div(2 * tp, 2 * tp + fp + fn).alias("f1"), M._div(tp + tn, F.col("total_evaluated")).alias("accuracy"),
        "brier", F.lit(roc).cast("double").alias("roc_auc"))


# --- P4 -------------------------------------------------------------------------------
def known_values(catalog: DataFrame, columns: Sequence[str] = C.CATEGORICAL_FEATURES) -> DataFrame:
    """Allowed codes per column = catalog codes plus 'missing' and 'unknown' (long form)."""
    cat = catalog.where(F.col("column").isin(list(columns))).select("column", "code")
    extra = catalog.select("column").where(F.col("column").isin(list(columns))).distinct().select(
        "column", F.explode(F.array(F.lit(C.MISSING_CODE), F.lit(C.UNKNOWN_CODE))).alias("code"))
    return cat.unionByName(extra).distinct()


# --- P26 / W6 / J6 -----------------------------------------------------------------------
def feedback_rules(requests: DataFrame, max_len: int = C.FEEDBACK_COMMENT_MAX) -> DataFrame:
    """Type domain, comment length (raw), comment trimmed->NULL, usefulness needs a comment.

    Adds ``comment_clean`` and ``reject_code`` (NULL when valid).
    """
    clean = X.blank_to_null("comment")
    code = (F.when(~F.col("feedback_type").isin(*C.FEEDBACK_TYPES) | F.col("feedback_type").isNull(),
                   F.lit("INVALID_FEEDBACK_TYPE"))
            .when(F.length("comment") > max_len, F.lit("COMMENT_TOO_LONG"))
            .when((F.col("feedback_type") == "usefulness") & clean.isNull(), F.lit("COMMENT_REQUIRED")))
    return requests.withColumns({"comment_clean": clean, "reject_code": code})


def actual_outcome(processes: DataFrame) -> DataFrame:
    """J6 outcome per process: 1 completed after deadline, 0 on time, NULL without SLA or open."""
    return processes.select(
        F.col("process_id"),
        F.when(F.col("deadline").isNotNull() & F.col("completed_at").isNotNull(),
               (F.col("completed_at") > F.col("deadline")).cast("int")).alias("actual_outcome"))


def feedback_upsert(requests: DataFrame, predictions: DataFrame, processes: DataFrame,
                    existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Last submission per (prediction, type) wins; simulation predictions refused.

    ``requests``: request_id, prediction_id, feedback_type, comment, created_at.
    ``processes``: process_id, deadline, completed_at.  Returns ``state``
    (prediction_id, feedback_type, comment, actual_outcome, created_at) and
    ``rejects`` (request_id, prediction_id, reject_code).
    The latest-wins step is an aggregate (partial, skew-safe), not a window.
    """
    r = feedback_rules(requests)
    pred = predictions.select(F.col("id").alias("prediction_id"), "process_id", "prediction_context")
    j = r.join(pred, "prediction_id", "left")
    code = (F.coalesce(F.col("reject_code"),
                       F.when(F.col("prediction_context").isNull(), F.lit("PREDICTION_NOT_FOUND"))
                       .when(F.col("prediction_context") == "simulation", F.lit("FEEDBACK_NOT_ALLOWED"))))
    j = j.withColumn("reject_code", code)
    rejects = j.where(F.col("reject_code").isNotNull()).select("request_id", "prediction_id", "reject_code")
    ok = j.where(F.col("reject_code").isNull())
    outc = actual_outcome(processes)
    ok = ok.join(outc, "process_id", "left").withColumn(
        "actual_outcome", F.when(F.col("feedback_type") == "accuracy", F.col("actual_outcome")))
    rows = ok.select("prediction_id", "feedback_type", F.col("comment_clean").alias("comment"), "actual_outcome",
                     "created_at", F.col("request_id").alias("_seq"))
    if existing is not None:
        rows = existing.select("prediction_id", "feedback_type", "comment", "actual_outcome", "created_at",
                               F.lit(-1).cast("long").alias("_seq")).unionByName(rows)
    last = rows.groupBy("prediction_id", "feedback_type").agg(
        F.max_by(F.struct("comment", "actual_outcome", "created_at"), F.struct("created_at", "_seq")).alias("v"))
    state = last.select("prediction_id", "feedback_type", "v.comment", "v.actual_outcome", "v.created_at")
    return {"state": state, "rejects": rejects}


# --- P27 / J9 / X7 ------------------------------------------------------------------------
def override_rules(scenarios: DataFrame, options: DataFrame) -> DataFrame:
    """Numeric ranges, categorical codes must be allowed options, at least one override.

    ``scenarios``: scenario_id, base_prediction_id, process_id and one nullable
    column per feature override.  ``options``: (column, code) from :func:`known_values`.
    Adds ``reject_code`` (first failing rule).  Codes are taken as given: white
    space around one makes it a code that is not allowed.
    """
    s = scenarios
    for c in C.CATEGORICAL_FEATURES:
        opt = options.where(F.col("column") == c).select(F.col("code").alias(f"_ok_{c}"))
        s = s.join(opt, s[c] == opt[f"_ok_{c}"], "left")
    bad_range = None
    for c, (lo, hi) in C.OVERRIDE_RANGES.items():
        cond = F.col(c).isNotNull() & ~F.col(c).between(lo, hi)
        bad_range = cond if bad_range is None else bad_range | cond
    bad_cat = None
    for c in C.CATEGORICAL_FEATURES:
        cond = F.col(c).isNotNull() & (~F.col(c).rlike("^[a-z0-9_]{1,120}$") | F.col(f"_ok_{c}").isNull())
        bad_cat = cond if bad_cat is None else bad_cat | cond
    none_set = None
    for c in C.ALL_FEATURES:
        cond = F.col(c).isNull()
        none_set = cond if none_set is None else none_set & cond
    code = (F.when(none_set, F.lit("NO_OVERRIDE")).when(bad_range, F.lit("OVERRIDE_OUT_OF_RANGE"))
            .when(bad_cat, F.lit("OVERRIDE_NOT_ALLOWED")))
    return s.withColumn("reject_code", code).drop(*[f"_ok_{c}" for c in C.CATEGORICAL_FEATURES])


def scenario_merge(scenarios: DataFrame, predictions: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    """J9 + X7: base prediction must be this process's successful opening prediction; the
    snapshot features are overridden where the scenario sets a value.

    ``features``: process_id + the 10 opening features of usable snapshots
    (:func:`docket.operators.dataset.scoring_features`).  is_weekend is not
    recomputed when the weekday changes (kept as in the reference, Q23);
    ``has_sla`` follows the effective SLA hours (Q6).
    """
    base = predictions.where((F.col("status") == "success") & (F.col("prediction_context") == "opening")).select(
        F.col("id").alias("base_prediction_id"), F.col("process_id").alias("_bp"), "model_bundle_id")
    j = scenarios.join(base, "base_prediction_id", "left")
    no_base = F.col("_bp").isNull() | (F.col("_bp") != F.col("process_id"))
    f = features.select("process_id", *[F.col(c).alias(f"_f_{c}") for c in C.ALL_FEATURES], F.lit(1).alias("_snap"))
    j = j.join(f, "process_id", "left")
    code = F.coalesce(F.col("reject_code"), F.when(no_base, F.lit("BASE_PREDICTION_NOT_FOUND"))
                      .when(F.col("_snap").isNull(), F.lit("SNAPSHOT_NOT_FOUND")))
    j = j.withColumn("reject_code", code)
    merged = j.where(F.col("reject_code").isNull()).select(
        "scenario_id", "process_id", "base_prediction_id", "model_bundle_id",
        *[F.coalesce(F.col(c), F.col(f"_f_{c}")).alias(c) for c in C.ALL_FEATURES],
    ).withColumn("has_sla", F.col("sla_duration_hours").isNotNull().cast("int")).withColumn(
        "prediction_context", F.lit("simulation"))
    rejects = j.where(F.col("reject_code").isNotNull()).select("scenario_id", "process_id", "reject_code")
    return {"merged": merged, "rejects": rejects}


# --- F10 / J8 / W7 / A19 ---------------------------------------------------------------------
def batch_id_rules(requests: DataFrame) -> DataFrame:
    """ids must be positive and unique within the request (per-id verdict, no size cap)."""
    counts = requests.groupBy("process_id").agg(F.count(F.lit(1)).alias("_n"))
    j = requests.join(counts.hint("merge"), "process_id")  # a row per id: as long as the requests, never broadcast
    return j.withColumn("reject_code", F.when(F.col("process_id") <= 0, F.lit("NON_POSITIVE_ID"))
                        .when(F.col("_n") > 1, F.lit("DUPLICATE_ID"))).drop("_n")


def reuse_plan(requests: DataFrame, snapshots: DataFrame, prior: DataFrame, bundle_id: int,
               context: str = "opening") -> DataFrame:
    """J8 + W7: reuse an existing success with the same (snapshot, fingerprint, bundle,
    context); everything else is scored.  One row per requested id with ``action``.

    ``snapshots``: process_id, snapshot_id, input_fingerprint.  ``prior``:
    id, snapshot_id, input_fingerprint, model_bundle_id, prediction_context, status.
    When several prior successes share the identity the highest id is reused
    (the identity is unique after :func:`dedupe_successes`).
    """
    r = batch_id_rules(requests)
    # snapshots and prior runs grow with the cases; their estimated size is that of compressed files, so it is no ground for a broadcast
    j = r.join(snapshots.hint("merge"), "process_id", "left")
    p = prior.where((F.col("status") == "success") & (F.col("model_bundle_id") == bundle_id)
                    & (F.col("prediction_context") == context)).groupBy("snapshot_id", "input_fingerprint").agg(
        F.max("id").alias("reused_prediction_id"))
    j = j.join(p.hint("merge"), ["snapshot_id", "input_fingerprint"], "left")
    action = (F.when(F.col("reject_code").isNotNull(), F.lit("rejected"))
              .when(F.col("snapshot_id").isNull(), F.lit("failed"))
              .when(F.col("reused_prediction_id").isNotNull(), F.lit("reuse"))
              .otherwise(F.lit("score")))
    error = F.coalesce(F.col("reject_code"), F.when(F.col("snapshot_id").isNull(), F.lit("SNAPSHOT_NOT_FOUND")))
    return j.select("process_id", action.alias("action"), error.alias("error_code"),
                    F.when(F.col("reject_code").isNull(), F.col("reused_prediction_id")).alias("reused_prediction_id"))


def dedupe_successes(preds: DataFrame) -> DataFrame:
    """Keep one success per (snapshot, fingerprint, bundle, context) before a write."""
    ok = preds.where(F.col("status") == "success").dropDuplicates(
        ["snapshot_id", "input_fingerprint", "model_bundle_id", "prediction_context"])
    return ok.unionByName(preds.where(F.col("status") != "success"))


def batch_outcome_counts(plan: DataFrame) -> DataFrame:
    """Succeeded (scored or reused) vs failed (rejected or failed)."""
    okc = F.col("action").isin("score", "reuse")
    return plan.agg(F.sum(F.when(okc, 1).otherwise(0)).cast("bigint").alias("succeeded"),
                    F.sum(F.when(~okc, 1).otherwise(0)).cast("bigint").alias("failed"))
