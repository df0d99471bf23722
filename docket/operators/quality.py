"""Profiling, cleaning report, pattern scans, domain constraints.

Two quartile definitions are kept on purpose (quirk Q15):
* :func:`numeric_profile` uses linear interpolation (NumPy default);
* :func:`cleaning_report` uses the index quantile ``s[int(n q)]``.
Both are exact and sort based; neither buffers a group in memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket import config as C
from docket.operators.ordering import exact_quantiles, global_index


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A8 summary: per column missing (NULL or blank), missing %, distinct non-blank count.

    One pass: the columns are unpivoted to (column, value) and aggregated.
    """
    total = F.count(F.lit(1))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("kv")
    ).select("kv.*")
    blank = F.col("value").isNull() | (F.trim(F.col("value")) == "")
    return long.groupBy("column").agg(
        F.sum(F.when(blank, 1).otherwise(0)).cast("bigint").alias("missing"),
        F.round(F.sum(F.when(blank, 1).otherwise(0)) / total * 100, 2).alias("missing_pct"),
        F.count_distinct(F.when(~blank, F.col("value"))).alias("unique"),
    )


def categorical_top(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """A8 top-n: most frequent non-blank values per column (ties: value ascending)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("kv")
    ).select("kv.*").where(F.col("value").isNotNull() & (F.trim(F.col("value")) != ""))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def numeric_profile(df: DataFrame, value_col: str, iqr_mult: float = C.IQR_MULTIPLIER) -> DataFrame:
    """Count, missing, min, max, mean, median, population std, q1, q3, IQR, outliers (one row).

    Quartiles are exact (distributed sort); the one-row quantile result is read
    as scalars and the rest is a single aggregate over ``df`` (no joins).
    """
    x = F.col(value_col)
    q = exact_quantiles(df, [], value_col, {"q1": 0.25, "median": 0.5, "q3": 0.75}).first()  # one row
    q1, med, q3 = q["q1"], q["median"], q["q3"]
    lo = hi = None
    if q1 is not None:
        iqr = q3 - q1
        lo, hi = q1 - iqr_mult * iqr, q3 + iqr_mult * iqr
    out_cond = (x < F.lit(lo)) | (x > F.lit(hi)) if lo is not None else F.lit(False)
    return df.agg(
        F.count(x).alias("count"), (F.count(F.lit(1)) - F.count(x)).alias("missing"), F.min(x).alias("min"),
        F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.sum(F.when(x.isNotNull() & out_cond, 1).otherwise(0)).cast("bigint").alias("outliers_iqr"),
    ).select("count", "missing", "min", "max", "mean", F.lit(med).cast("double").alias("median"), "std",
             F.lit(q1).cast("double").alias("q1"), F.lit(q3).cast("double").alias("q3"),
             F.lit(None if q1 is None else q3 - q1).cast("double").alias("iqr"), "outliers_iqr")


def duplicate_keys(df: DataFrame, key: str, top: int = 10) -> DataFrame:
    """A10: keys seen more than once, top-n by count (ties: key ascending)."""
    return (df.where(F.col(key).isNotNull() & (F.trim(F.col(key)) != "")).groupBy(key)
            .agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
            .orderBy(F.col("count").desc(), F.col(key).asc()).limit(top))


def index_quantile_bounds(values: DataFrame, value_col: str, iqr_mult: float = C.IQR_MULTIPLIER) -> dict:
    """A12 bounds: q1 = s[int(0.25 n)], q3 = s[int(0.75 n)] of the sorted values (0 when n < 4).

    Returns the scalars n, q1, q3, lower, upper (ranks from the distributed index).
    """
    v = values.where(F.col(value_col).isNotNull()).select(F.col(value_col).alias("x"))
    idx = global_index(v, ["x"], "_i")
    n = idx.count()  # read from the checkpointed index
    if n < 4:
        return {"n": n, "q1": 0.0, "q3": 0.0, "lower": 0.0, "upper": 0.0}
    i1, i3 = int(n * 0.25), int(n * 0.75)
    r = idx.where(F.col("_i").isin(i1, i3)).agg(
        F.max(F.when(F.col("_i") == i1, F.col("x"))).alias("q1"),
        F.max(F.when(F.col("_i") == i3, F.col("x"))).alias("q3")).first()  # one row
    q1, q3 = float(r["q1"]), float(r["q3"])
    return {"n": n, "q1": q1, "q3": q3, "lower": q1 - iqr_mult * (q3 - q1), "upper": q3 + iqr_mult * (q3 - q1)}


def cleaning_report(closed: DataFrame, duration_col: str = "duration_hours",
                    iqr_mult: float = C.IQR_MULTIPLIER) -> DataFrame:
    """A12 report (one row): totals, negatives, index-quantile bounds, outliers below/above, % above.

    ``closed`` has one row per completed case with the signed duration.
    "Below" outliers are counted only when the lower bound is positive.
    Bounds are scalars; the counts are one aggregate (no joins).
    """
    d = F.col(duration_col)
    b = index_quantile_bounds(closed.where(d >= 0), duration_col, iqr_mult)
    below = (d < F.lit(b["lower"])) if b["lower"] > 0 else F.lit(False)
    agg = closed.agg(
        F.count(F.lit(1)).alias("total_completed"),
        F.sum(F.when(d >= 0, 1).otherwise(0)).cast("bigint").alias("valid_durations"),
        F.sum(F.when(d < 0, 1).otherwise(0)).cast("bigint").alias("negative_duration_count"),
        F.sum(F.when((d >= 0) & below, 1).otherwise(0)).cast("bigint").alias("outliers_below_lower"),
        F.sum(F.when((d >= 0) & (d > F.lit(b["upper"])), 1).otherwise(0)).cast("bigint").alias("outliers_above_upper"))
    return agg.select(
        "total_completed", "valid_durations", "negative_duration_count",
        *[F.round(F.lit(b[k]).cast("double"), 2).alias(k) for k in ("q1", "q3", "lower", "upper")],
        F.coalesce("outliers_below_lower", F.lit(0)).alias("outliers_below_lower"),
        F.coalesce("outliers_above_upper", F.lit(0)).alias("outliers_above_upper"),
        F.when(F.col("valid_durations") > 0,
               F.round(F.coalesce("outliers_above_upper", F.lit(0)) / F.col("valid_durations") * 100, 1))
        .otherwise(F.lit(0.0)).alias("outliers_above_pct"))


def negative_samples(closed: DataFrame, order_col: str, duration_col: str = "duration_hours", n: int = 10
                     ) -> DataFrame:
    """A12 sample: first n negative-duration cases in id order (duration rounded to 2)."""
    return (closed.where(F.col(duration_col) < 0).orderBy(order_col).limit(n)
            .withColumn(duration_col, F.round(duration_col, 2)))


def winsorize(df: DataFrame, value_col: str, bounds: dict, enabled: bool = True) -> DataFrame:
    """Clamp to [lower, upper] (scalars from :func:`index_quantile_bounds`); off -> unchanged."""
    if not enabled:
        return df.withColumn(f"{value_col}_capped", F.col(value_col))
    x = F.col(value_col)
    return df.withColumn(f"{value_col}_capped", F.when(x.isNotNull(), F.least(
        F.greatest(x, F.lit(float(bounds["lower"]))), F.lit(float(bounds["upper"])))))


def invalid_year_flags(df: DataFrame, ts_col: str, min_year: int = C.CLEANING_MIN_YEAR,
                       max_year: int = C.CLEANING_MAX_YEAR) -> DataFrame:
    """Flag rows whose year is outside [min_year, max_year] (reported, never dropped)."""
    y = F.year(ts_col)
    return df.withColumn("invalid_year", (y.isNotNull() & ~y.between(min_year, max_year)).cast("int"))


def pattern_scan(df: DataFrame, text_col: str, id_col: str,
                 patterns: Sequence[tuple[str, str]] = C.SENSITIVE_PATTERNS) -> DataFrame:
    """per row, hit count of each pattern (Java regex, lookbehind allowed)."""
    return df.select(id_col, *[F.regexp_count(F.col(text_col), F.lit(p)).alias(name) for name, p in patterns])


def pattern_totals(scan: DataFrame, names: Sequence[str]) -> DataFrame:
    """F12 summary: (pattern, rows_with_hits, total_hits)."""
    long = scan.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("pattern"), F.col(n).alias("hits")) for n in names])).alias("kv")).select("kv.*")
    return long.groupBy("pattern").agg(
        F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).cast("bigint").alias("rows_with_hits"),
        F.sum("hits").cast("bigint").alias("total_hits"))


def external_refs(df: DataFrame, text_col: str, id_col: str, pattern: str = C.EXTERNAL_ASSET_PATTERN) -> DataFrame:
    """every external asset URL found, one row per (id, match)."""
    return df.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).alias("url"))


def external_ref_counts(df: DataFrame, text_col: str, id_col: str, pattern: str = C.EXTERNAL_ASSET_PATTERN
                        ) -> DataFrame:
    """F13 per row: number of external asset references (0 included)."""
    return df.select(id_col, F.regexp_count(F.col(text_col), F.lit(pattern)).alias("external_refs"))


def domain_violations(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """one aggregate pass; ``rules`` maps a rule name to a boolean Column that must hold.

    NULL rule results count as satisfied (SQL CHECK semantics).
    """
    aggs = [F.sum(F.when(~F.coalesce(cond, F.lit(True)), 1).otherwise(0)).cast("bigint").alias(name)
            for name, cond in rules.items()]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("kv")).select("kv.*")


def run_rules() -> dict[str, object]:
    """F14 for import runs: status domain and counters that are never negative."""
    counters = ["total_rows", "imported_rows", "inserted_rows", "updated_rows", "skipped_duplicate_rows", "quarantined_rows", "error_rows",
                "warning_count"]
    return {"status_domain": F.col("status").isin(*C.IMPORT_STATUSES), **{f"{c}_not_negative": F.col(c) >= 0 for c in counters}}


def issue_rules() -> dict[str, object]:
    """F14 for data-quality issues: severity and issue code domains (a NULL code is allowed)."""
    return {"severity_domain": F.col("severity").isin(*C.SEVERITIES), "issue_code_domain": F.col("issue_code").isin(*C.ISSUE_CODES)}


def run_summary(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """Run totals and issue counts by severity in one aggregate over the union of both tables."""
    run_cols = ["total_rows", "imported_rows", "quarantined_rows", "error_rows", "warning_count"]
    r = runs.select(F.lit(1).alias("_run"), F.lit(0).alias("_issue"), F.lit(None).cast("string").alias("severity"),
                    *[F.col(c).cast("bigint").alias(c) for c in run_cols])
    i = issues.select(F.lit(0).alias("_run"), F.lit(1).alias("_issue"), "severity",
                      *[F.lit(None).cast("bigint").alias(c) for c in run_cols])
    u = r.unionByName(i)
    return u.agg(
        F.sum("_run").cast("bigint").alias("total_import_runs"),
        *[F.sum(c).cast("bigint").alias(c) for c in run_cols],
        F.sum("_issue").cast("bigint").alias("issue_count"),
        F.sum(F.when(F.col("severity") == "error", 1).otherwise(0)).cast("bigint").alias("error_issues"),
        F.sum(F.when(F.col("severity") == "warning", 1).otherwise(0)).cast("bigint").alias("warning_issues"))


def issues_by_code(issues: DataFrame) -> DataFrame:
    """Issue counts by code, NULL code reported as UNKNOWN."""
    return issues.groupBy(F.coalesce(F.col("issue_code"), F.lit("UNKNOWN")).alias("code")).agg(
        F.count(F.lit(1)).alias("count"))


def recent_runs(runs: DataFrame, n: int = C.RECENT_RUNS) -> DataFrame:
    """Latest n runs by completion time, then id, descending."""
    return runs.orderBy(F.col("completed_at").desc_nulls_last(), F.col("run_id").desc()).limit(n)
