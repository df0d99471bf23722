"""Dashboards, process list/detail, prediction history.

Skew: "latest prediction per process" and "history per process" are
``row_number`` filters.  Spark inserts a partial ``WindowGroupLimit`` before
the shuffle for ``rn <= k`` (k well under the optimizer threshold), so a hot
process contributes at most k rows per map task to the exchange.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket import config as C
from docket.functions import exprs as X


def _recent_success(preds: DataFrame, as_of: _dt.datetime | None, days: int, bundle_id: int | None) -> DataFrame:
    cond = (F.col("status") == "success") & (F.col("prediction_context") == "opening")
    if as_of is not None:
        cond = cond & (F.col("predicted_at") >= X.ts_lit(as_of - _dt.timedelta(days=days)))
    if bundle_id is not None:
        cond = cond & (F.col("model_bundle_id") == bundle_id)
    return preds.where(cond)


def prediction_kpis(preds: DataFrame, as_of: _dt.datetime, days: int = C.DASHBOARD_DAYS,
                    bundle_id: int | None = None) -> DataFrame:
    """A2: count, high-risk count, avg probability and hours (0 when empty); one aggregate."""
    p = _recent_success(preds, as_of, days, bundle_id)
    return p.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.coalesce(F.sum(F.when(F.col("predicted_is_delayed") == 1, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(
            "high_risk_count"),
        F.coalesce(F.avg("delay_probability"), F.lit(0.0)).alias("avg_delay_probability"),
        F.coalesce(F.avg("predicted_hours"), F.lit(0.0)).alias("avg_predicted_hours"),
    )


def daily_volume(preds: DataFrame, as_of: _dt.datetime, days: int = C.DASHBOARD_DAYS,
                 bundle_id: int | None = None) -> DataFrame:
    """A4: successful opening predictions per calendar day, ascending."""
    p = _recent_success(preds, as_of, days, bundle_id)
    day = F.date_format(F.to_date("predicted_at"), "yyyy-MM-dd").alias("day")
    return p.groupBy(day).agg(F.count(F.lit(1)).alias("count")).orderBy("day")


def process_type_distribution(processes: DataFrame, top: int = C.TOP_PROCESS_TYPES,
                              null_label: str = C.PROCESS_TYPE_NULL_LABEL) -> DataFrame:
    """A5: NULL bucketed under a label, top-n by count desc then label asc (partial agg, then top-n)."""
    label = F.coalesce(F.col("process_type"), F.lit(null_label)).alias("process_type")
    return (processes.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("process_type").asc()).limit(top))


def latest_prediction(preds: DataFrame, bundle_id: int | None = None, context: str = "opening") -> DataFrame:
    """Newest successful prediction per process (tie-break: higher id)."""
    cond = (F.col("status") == "success") & (F.col("prediction_context") == context)
    if bundle_id is not None:
        cond = cond & (F.col("model_bundle_id") == bundle_id)
    w = Window.partitionBy("process_id").orderBy(F.col("predicted_at").desc(), F.col("id").desc())
    return preds.where(cond).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def prediction_history(preds: DataFrame, limit: int = C.HISTORY_LIMIT) -> DataFrame:
    """All contexts and statuses, newest first, at most ``limit`` per process."""
    w = Window.partitionBy("process_id").orderBy(F.col("predicted_at").desc(), F.col("id").desc())
    return preds.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def process_with_prediction(processes: DataFrame, preds: DataFrame, bundle_id: int | None,
                            status_filter: str | None = None, risk_filter: str | None = None) -> DataFrame:
    """J2 + F7 + F8: processes left-joined to their latest prediction, filtered.

    Unlike the reference, the risk filter applies even without a bundle
    (quirk Q22 dropped).  The process id is ``o_orderkey`` on the test tables.
    """
    latest = latest_prediction(preds, bundle_id).select(
        F.col("process_id"), "delay_probability", "risk_score", "risk_level", "predicted_is_delayed", "predicted_hours"
    )
    j = processes.join(latest, processes["o_orderkey"] == latest["process_id"], "left").drop("process_id")
    if status_filter == "open":
        j = j.where(F.col("completed_at").isNull())
    elif status_filter == "closed":
        j = j.where(F.col("completed_at").isNotNull())
    if risk_filter == "high_risk":
        j = j.where(F.col("predicted_is_delayed") == 1)
    elif risk_filter == "low_risk":
        j = j.where(F.col("predicted_is_delayed").isNotNull() & (F.col("predicted_is_delayed") != 1))
    has = F.col("delay_probability").isNotNull() | F.col("predicted_hours").isNotNull()
    return j.withColumn("has_prediction", has.cast("int"))


def process_page(listing: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """created_at desc (tie-break external_id), offset/limit (a top-k: bounded output)."""
    return listing.orderBy(F.col("created_at").desc(), F.col("external_id").asc()).offset((page - 1) * per_page).limit(
        per_page)


def process_detail(processes: DataFrame, features: DataFrame, preds: DataFrame, bundle_id: int | None = None) -> DataFrame:
    """R1 as a table: opening features vs current fields vs latest prediction, per process.

    ``features`` carries external_id + the 10 opening features (from the snapshot).
    """
    latest = latest_prediction(preds, bundle_id).select(
        F.col("process_id"), F.col("id").alias("prediction_id"), "delay_probability", "risk_score", "risk_level",
        "predicted_hours", "model_version")
    base = processes.select(
        "o_orderkey", "external_id", "process_type", "current_status", "completed_at", "deadline", "closure_reason",
        F.when(F.col("completed_at").isNotNull(), X.elapsed_hours("created_at", "completed_at")).alias(
            "total_duration_hours"),
        F.col("deadline").isNotNull().cast("int").alias("has_sla"),
    )
    j = base.join(features, "external_id", "left")
    return j.join(latest, j["o_orderkey"] == latest["process_id"], "left").drop("process_id")


def dashboard_long(pred_kpis: DataFrame, actual_kpis: DataFrame) -> DataFrame:
    """R2: KPI sections as (section, metric, value) rows; union, no cross join."""
    def melt(df: DataFrame, section: str) -> DataFrame:
        cols = df.columns
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in cols])).alias("kv")).select("kv.*")

    return melt(pred_kpis, "prediction_kpis").unionByName(melt(actual_kpis, "actual_kpis"))
