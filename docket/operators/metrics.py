"""Evaluation metrics on scored tables.

Inputs are plain DataFrames with a label ``y`` (0/1), a probability ``p``
and a grouping (usually ``split``).  Everything is aggregates:

* confusion counts, Brier: one conditional-sum pass over the rows;
* ROC-AUC (ties share rank) and average precision: the rows are first
  reduced to one row per (group, distinct score) with positive/negative
  counts (partial aggregation, so a hot score costs nothing), then exact
  prefix sums over scores (:func:`ordering.bucketed_prefix_sums`);
* quantiles: exact, sort based (:func:`ordering.exact_quantiles`).

Sealed splits (F9): metric columns are NULL for splits in ``sealed`` unless
``allow_sealed``; counts stay visible.  Unknown split names raise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket import config as C
from docket.functions import exprs as X
from docket.operators.ordering import bucketed_prefix_sums, exact_quantiles, global_index

ALL_SPLITS = [*C.ALLOWED_EVAL_SPLITS, *C.SEALED_SPLITS]


def assert_evaluable(split: str, allow_sealed: bool = False) -> None:
    """F9 for one requested split name."""
    if split not in ALL_SPLITS:
        raise ValueError(f"unknown split {split!r}; valid: {sorted(ALL_SPLITS)}")
    if split in C.SEALED_SPLITS and not allow_sealed:
        raise PermissionError(f"split {split!r} is sealed")


def _div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, group: Sequence[str], threshold: float = C.DEFAULT_THRESHOLD,
              pred_col: str | None = None) -> DataFrame:
    """E1 (+E5): tn/fp/fn/tp, precision, recall, f1, accuracy, brier per group; zero division -> 0."""
    yp = F.col(pred_col) if pred_col else (F.col("p") >= F.lit(threshold)).cast("int")
    y = F.col("y")
    agg = scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.when((y == 0) & (yp == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
        F.sum(F.when((y == 0) & (yp == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when((y == 1) & (yp == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when((y == 1) & (yp == 1), 1).otherwise(0)).cast("bigint").alias("tp"),
        F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(
        *group, "row_count", "tn", "fp", "fn", "tp",
        _div(tp, tp + fp).alias("precision"),
        _div(tp, tp + fn).alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _div(tp + tn, F.col("row_count")).alias("accuracy"),
        "brier",
    )


def score_histogram(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, p) -> pos, neg counts (partial aggregation before the shuffle)."""
    return scored.groupBy(*group, "p").agg(
        F.sum(F.col("y")).cast("long").alias("pos"),
        F.sum(1 - F.col("y")).cast("long").alias("neg"),
    )


def ranking_metrics(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """E2 ROC-AUC (ties count 1/2; NULL with one class) and E3 average precision."""
    hist = score_histogram(scored, group)
    j = bucketed_prefix_sums(hist, group, "p", ["pos", "neg"]).withColumnsRenamed({"pos_total": "n_pos", "neg_total": "n_neg"})
    # rows with score >= p: total minus strictly-below
    tp_at = F.col("n_pos") - F.col("pos_below")
    all_at = (F.col("n_pos") + F.col("n_neg")) - (F.col("pos_below") + F.col("neg_below"))
    auc_term = F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))
    ap_term = F.when(F.col("pos") > 0, (F.col("pos") / F.col("n_pos")) * (tp_at / all_at)).otherwise(F.lit(0.0))
    agg = j.groupBy(*group).agg(F.sum(auc_term).alias("_auc"), F.sum(ap_term).alias("pr_auc"),
                                F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    return agg.select(
        *group,
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_auc") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
        F.when(F.col("n_pos") > 0, F.col("pr_auc")).alias("pr_auc"),
    )


def classification_metrics(scored: DataFrame, group: str = "split", threshold: float = C.DEFAULT_THRESHOLD,
                           sealed: Sequence[str] = C.SEALED_SPLITS, allow_sealed: bool = False) -> DataFrame:
    """E1 + E2 + E3 + E5 per split, with the F9 seal applied."""
    s = scored.where(F.col("y").isNotNull() & F.col(group).isNotNull())
    m = confusion(s, [group], threshold).join(ranking_metrics(s, [group]), group)
    if allow_sealed:
        return m
    hide = F.col(group).isin(list(sealed))
    metric_cols = [c for c in m.columns if c not in (group, "row_count")]
    return m.select(group, "row_count", *[F.when(~hide, F.col(c)).alias(c) for c in metric_cols])


def regression_metrics(regressed: DataFrame, group: str = "split", sealed: Sequence[str] = C.SEALED_SPLITS,
                       allow_sealed: bool = False) -> DataFrame:
    """MAE, median AE, RMSE, p90 AE (linear percentiles, exact)."""
    e = regressed.where(F.col("y").isNotNull() & F.col("yhat").isNotNull() & F.col(group).isNotNull()).select(
        group, F.abs(F.col("y") - F.col("yhat")).alias("ae"))
    base = e.groupBy(group).agg(F.count(F.lit(1)).alias("row_count"), F.avg("ae").alias("mae"),
                                F.sqrt(F.avg(F.col("ae") * F.col("ae"))).alias("rmse"))
    q = exact_quantiles(e, [group], "ae", {"median_ae": 0.5, "p90_abs_error": 0.9})
    m = base.join(q, group)
    if allow_sealed:
        return m
    hide = F.col(group).isin(list(sealed))
    return m.select(group, "row_count", *[F.when(~hide, F.col(c)).alias(c) for c in ("mae", "median_ae", "rmse",
                                                                                       "p90_abs_error")])


def threshold_table(scored: DataFrame, group: Sequence[str] = ("split",)) -> DataFrame:
    """F1 at the 17 cuts 0.10..0.90; ``is_best`` marks max F1, lowest cut on ties,
    and the cut of one half where no cut has a positive F1.

    Works on the score histogram: each distinct score contributes to the cuts
    it reaches (at most 17 rows per distinct score, no join).
    """
    group = list(group)
    cuts = F.array(*[F.lit(c) for c in X.threshold_cuts()])
    hist = score_histogram(scored.where(F.col("y").isNotNull()), group)
    tot = hist.groupBy(*group).agg(F.sum("pos").alias("n_pos"))
    reach = hist.select(*group, "pos", "neg", F.explode(F.filter(cuts, lambda c: F.col("p") >= c)).alias("cut"))
    per = reach.groupBy(*group, "cut").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    # every cut must appear, also those no score reaches
    grid = tot.select(*group, "n_pos", F.explode(cuts).alias("cut"))
    t = grid.join(per, [*group, "cut"], "left").fillna(0, ["tp", "fp"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("n_pos") - F.col("tp")
    t = t.select(*group, "cut", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                 _div(tp, tp + fp).alias("precision"), _div(tp, F.col("n_pos")).alias("recall"),
                 _div(2 * tp, 2 * tp + fp + fn).alias("f1"))
    # without any positive F1 the default cut of one half stands
    idle = F.when((F.col("f1") == 0) & (F.abs(F.col("cut") - C.IDLE_THRESHOLD) < 1e-9), 0).otherwise(1)
    w = Window.partitionBy(*group).orderBy(F.col("f1").desc(), idle, F.col("cut").asc())  # 17 rows per group
    return t.withColumn("is_best", (F.row_number().over(w) == 1).cast("int"))


def calibration_choice(scored_methods: DataFrame, group: Sequence[str] = ("split",),
                       order: Sequence[str] = ("uncalibrated", "sigmoid", "isotonic")) -> DataFrame:
    """Brier per (group, method); the lowest wins, earlier method on ties."""
    group = list(group)
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    b = scored_methods.groupBy(*group, "method").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    best = b.groupBy(*group).agg(F.min(F.struct("brier", rank.alias("r"), "method")).alias("m"))
    return b.join(best.select(*group, F.col("m.method").alias("selected")), group).withColumn(
        "is_selected", (F.col("method") == F.col("selected")).cast("int")).drop("selected")


def pick_winner(metrics: DataFrame, metric: str, higher_is_better: bool, order_col: str = "model_order",
                group: Sequence[str] = ()) -> DataFrame:
    """Mark the winner (best metric, first model on ties) and rank all models."""
    key = F.col(metric).desc_nulls_last() if higher_is_better else F.col(metric).asc_nulls_last()
    w = Window.partitionBy(*group).orderBy(key, F.col(order_col).asc()) if group else Window.orderBy(
        key, F.col(order_col).asc())  # one row per model: tiny
    return metrics.withColumn("rank", F.row_number().over(w)).withColumn("is_winner", (F.col("rank") == 1).cast("int"))


def time_folds(cohort: DataFrame, n_splits: int = 5, order_cols: Sequence[str] = ("created_at", "external_id")
               ) -> DataFrame:
    """Expanding time folds like an sklearn TimeSeriesSplit.

    Rows are indexed in (created_at, external_id) order (distributed index);
    test size = n // (K+1); fold k tests [n - (K-k) ts, n - (K-k-1) ts) and
    trains on every index before that start.  Adds ``row_index`` and
    ``test_fold`` (NULL for rows that only ever train).
    """
    idx = global_index(cohort, list(order_cols), "row_index")
    n_val = idx.agg(F.count(F.lit(1)).alias("n")).first()["n"]  # one scalar
    ts_v = n_val // (n_splits + 1)
    start = n_val - n_splits * ts_v
    fold = F.when(F.col("row_index") >= start, F.floor((F.col("row_index") - start) / F.lit(max(ts_v, 1))))
    return (idx.withColumn("test_fold", F.when(fold < n_splits, fold).cast("int"))
            .withColumn("fold_test_size", F.lit(ts_v).cast("long"))
            .withColumn("first_test_index", F.lit(start).cast("long")))


def fold_membership(folded: DataFrame, n_splits: int = 5) -> DataFrame:
    """(fold, role) rows: 'test' for the fold's block, 'train' for every earlier index."""
    tsz, first = F.col("fold_test_size"), F.col("first_test_index")
    roles = F.array(*[
        F.struct(F.lit(k).alias("fold"),
                 F.when(F.col("test_fold") == k, F.lit("test"))
                 .when(F.col("row_index") < first + k * tsz, F.lit("train")).alias("role"))
        for k in range(n_splits)])
    return folded.select("*", F.explode(roles).alias("fr")).where(F.col("fr.role").isNotNull()).select(
        *folded.columns, F.col("fr.fold").alias("fold"), F.col("fr.role").alias("role"))


def drift(evaluations: DataFrame, metrics: Sequence[str] = ("f1", "brier"), order_col: str = "evaluated_at"
          ) -> DataFrame:
    """Delta and direction of each metric versus the previous evaluation (one row per report)."""
    w = Window.orderBy(order_col)  # one row per evaluation report: small
    out = evaluations
    for m in metrics:
        prev = F.lag(m).over(w)
        d = F.col(m) - prev
        out = out.withColumn(f"{m}_prev", prev).withColumn(f"{m}_delta", d).withColumn(
            f"{m}_direction",
            F.when(d.isNull(), None).when(d > 0, "up").when(d < 0, "down").otherwise("unchanged"))
    return out
