"""Elastic net from mergeable Gram sums.

One pass adds up z z' per time segment, z being a row's one-hot levels, its numbers (0 for NULL), a mark per NULL number, 1 and the
label.  Sums of segments give the sums of every expanding train set; imputing a median and scaling are linear in z, so
they are applied to the sums.  All folds and grid points are then solved by coordinate descent on matrices of the size of the
features, without another pass.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket import config as C
from docket.operators import trees as T
from docket.operators.ordering import exact_quantiles

TOLERANCE, SWEEPS = 1e-10, 5000


@dataclasses.dataclass
class Columns:
    """Names of the entries of z."""

    categorical: list[str]
    numeric: list[str]
    levels: list[list[str]]

    @property
    def names(self) -> list[str]:
        hot = [f"{c}={v}" for c, levels in zip(self.categorical, self.levels) for v in levels]
        return [*hot, *self.numeric, *[f"{c} is null" for c in self.numeric], "1", "label"]


def fit_columns(train: DataFrame, categorical: Sequence[str] = C.CATEGORICAL_FEATURES, numeric: Sequence[str] = C.NUMERIC_FEATURES) -> Columns:
    levels = [sorted(r[0] for r in train.select(F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_CODE)).alias(c)).distinct().collect()) for c in categorical]
    return Columns(list(categorical), list(numeric), levels)


def design_rows(rows: DataFrame, columns: Columns, segment: F.Column, label: F.Column) -> DataFrame:
    """The columns that :func:`designs` reads."""
    return rows.select(segment.cast("int").alias("segment"), label.cast("double").alias("label"), *[F.col(c).cast("string").alias(f"f_{c}") for c in columns.categorical],
                       *[F.col(c).cast("double").alias(f"f_{c}") for c in columns.numeric])


def designs(batches: Iterator[pa.RecordBatch], columns: Columns) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """z, labels and segments of the rows of each batch; z ends in 1 and the label."""
    layout = T.Layout(columns.categorical, [], columns.levels, [], [])
    hot, q = sum(len(v) for v in columns.levels), len(columns.numeric)
    start = np.concatenate([[0], np.cumsum([len(v) for v in columns.levels])]).astype(np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        z = np.zeros((b.num_rows, hot + 2 * q + 2))
        codes = layout.codes(pa.RecordBatch.from_arrays([b.column(f"f_{c}") for c in columns.categorical], columns.categorical)) if columns.categorical else None
        for f, levels in enumerate(columns.levels):
            known = np.flatnonzero(codes[:, f] < len(levels))
            z[known, start[f] + codes[known, f]] = 1.0
        for j, c in enumerate(columns.numeric):
            x = b.column(f"f_{c}").to_numpy(zero_copy_only=False).astype(float)
            z[:, hot + j], z[:, hot + q + j] = np.nan_to_num(x), np.isnan(x)
        z[:, -2], z[:, -1] = 1.0, b.column("label").to_numpy(zero_copy_only=False)
        yield z, z[:, -1].copy(), b.column("segment").to_numpy(zero_copy_only=False)


def gram_sums(rows: DataFrame, columns: Columns, segment: F.Column, label: F.Column) -> DataFrame:
    """``segment, i, j, total``: sums of z_i z_j over the rows of each segment (only those that are not 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for z, _, of in designs(batches, columns):
            for s in np.unique(of):
                mine = z[of == s]
                add = mine.T @ mine
                sums[int(s)] = add if int(s) not in sums else sums[int(s)] + add
        for s, total in sums.items():
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), s, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                                             ["segment", "i", "j", "total"])

    return design_rows(rows, columns, segment, label).mapInArrow(run, "segment int, i int, j int, total double").groupBy("segment", "i", "j").agg(F.sum("total").alias("total"))


def expanding(sums: DataFrame, size: int, n: int) -> np.ndarray:
    """(n, size, size): sums over the segments 0..k (features squared per segment are read back)."""
    out = np.zeros((n, size, size))
    got = sums.toArrow()
    s, i, j = (got.column(c).to_numpy() for c in ("segment", "i", "j"))
    out[s, i, j] = got.column("total").to_numpy()
    return np.cumsum(out, axis=0)


def coordinate_descent(cov: np.ndarray, xy: np.ndarray, alpha: float, l1_ratio: float) -> np.ndarray:
    """Minimises  w' cov w / 2 - xy' w + alpha l1_ratio |w|_1 + alpha (1 - l1_ratio) |w|^2 / 2."""
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w, rest = np.zeros(len(xy)), xy.copy()  # rest = xy - cov w
    live = [j for j in range(len(xy)) if cov[j, j] + l2 > 1e-14]
    for _ in range(SWEEPS):
        moved = 0.0
        for j in live:
            target = rest[j] + cov[j, j] * w[j]
            new = np.sign(target) * max(abs(target) - l1, 0.0) / (cov[j, j] + l2)
            if step := new - w[j]:
                rest -= cov[:, j] * step
                w[j] = new
                moved = max(moved, abs(step) * np.sqrt(cov[j, j] + l2))
        if moved <= TOLERANCE * (1 + np.abs(w).max(initial=0.0)):
            break
    return w


@dataclasses.dataclass
class LinearModel:
    """Coefficients on the raw features: a weight per level, a slope and the fill value per number."""

    columns: Columns
    weights: list[np.ndarray]
    slopes: np.ndarray
    medians: list[float]
    intercept: float
    log1p: bool = False

    def transform(self, df: DataFrame, out_col: str) -> DataFrame:
        """``df`` with the prediction, in plain expressions; levels that were not seen count nothing."""
        y = F.lit(float(self.intercept))
        for c, levels, w in zip(self.columns.categorical, self.columns.levels, self.weights):
            if used := [(v, float(x)) for v, x in zip(levels, w) if x]:
                of = F.create_map(*[F.lit(x) for pair in used for x in pair])
                y = y + F.coalesce(of[F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_CODE))], F.lit(0.0))
        for c, slope, median in zip(self.columns.numeric, self.slopes, self.medians):
            x = F.col(c).cast("double")
            y = y + F.lit(float(slope)) * F.when(x.isNull() | F.isnan(x), F.lit(float(median))).otherwise(x)
        return df.withColumn(out_col, F.expm1(y) if self.log1p else y)


    def save_to(self, path: str) -> None:
        """All of it as one JSON line below the new folder ``path``."""
        from pyspark.sql import SparkSession

        record = {**dataclasses.asdict(self), "weights": [w.tolist() for w in self.weights], "slopes": self.slopes.tolist()}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(path)


def load_linear(spark, path: str) -> LinearModel:
    """The model that :meth:`LinearModel.save_to` wrote."""
    r = json.loads(spark.read.text(path).first()["value"])
    return LinearModel(Columns(**r["columns"]), [np.array(w) for w in r["weights"]], np.array(r["slopes"]), r["medians"], r["intercept"], r["log1p"])


def moments(gram: np.ndarray, columns: Columns, medians: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Means and scales of one-hot columns (scale 1) and imputed numbers in a train set."""
    hot, q = sum(len(v) for v in columns.levels), len(columns.numeric)
    n, scale = max(gram[-2, -2], 1.0), np.ones(hot + q)
    mean = gram[:hot + q, -2] / n
    mean[hot:] += np.array(medians) * gram[hot + q:hot + 2 * q, -2] / n
    square = (np.diag(gram)[hot:hot + q] + np.array(medians) ** 2 * np.diag(gram)[hot + q:hot + 2 * q]) / n
    spread = np.sqrt(np.maximum(square - mean[hot:] ** 2, 0.0))
    scale[hot:] = np.where(spread > 1e-12 * (1 + np.abs(mean[hot:])), spread, 1.0)
    return mean, scale


def solve(gram: np.ndarray, columns: Columns, medians: Sequence[float], alpha: float, l1_ratio: float, log1p: bool = False) -> LinearModel:
    """Elastic net on imputed, scaled numbers and plain one-hot columns, from the sums of a train set."""
    hot, q = sum(len(v) for v in columns.levels), len(columns.numeric)
    turn = np.zeros((hot + q + 1, len(gram)))  # z -> (one-hot, imputed numbers, label)
    turn[:hot, :hot] = np.eye(hot)
    turn[hot:hot + q, hot:hot + q] = np.eye(q)
    turn[hot:hot + q, hot + q:hot + 2 * q] = np.diag(medians)
    turn[-1, -1] = 1.0
    n = gram[-2, -2]
    mean = turn @ gram[:, -2] / n
    cov = turn @ gram @ turn.T / n - np.outer(mean, mean)
    scale = np.ones(hot + q)
    spread = np.sqrt(np.maximum(np.diag(cov)[hot:hot + q], 0.0))
    scale[hot:] = np.where(spread > 1e-12 * (1 + np.abs(mean[hot:hot + q])), spread, 1.0)
    w = coordinate_descent(cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale, alpha, l1_ratio) / scale
    parts = np.split(w[:hot], np.cumsum([len(v) for v in columns.levels])[:-1]) if columns.levels else []
    return LinearModel(columns, parts, w[hot:], list(medians), float(mean[-1] - w @ mean[:-1]), log1p)


def expanding_medians(rows: DataFrame, numeric: Sequence[str], segment: F.Column, n: int) -> list[list[float]]:
    """Exact medians of the numbers over the segments 0..k, for every k < n (a number without values gets 0)."""
    long = rows.select(F.explode(F.sequence(segment.cast("int"), F.lit(n - 1))).alias("k"), *[F.col(c).cast("double").alias(c) for c in numeric])
    long = long.select("k", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("x")) for c in numeric])).alias("v")).select("k", "v.f", "v.x")
    got = {(r["k"], r["f"]): r["m"] for r in exact_quantiles(long, ["k", "f"], "x", {"m": 0.5}).collect()}  # n rows a feature
    return [[float(got.get((k, c)) or 0.0) for c in numeric] for k in range(n)]


def segment_of() -> F.Column:
    """0 for rows that only ever train, else 1 + the fold that tests them: fold k trains on the segments 0..k."""
    return F.coalesce(F.col("test_fold") + 1, F.lit(0))


def elastic_nets(folded: DataFrame, candidates: Sequence[dict], n_splits: int, log1p: bool = False) -> dict[tuple[int, int], LinearModel]:
    """(candidate, fold) -> model from one pass for the sums and one for the medians; fold ``n_splits`` is the fit on all rows."""
    columns = fit_columns(folded)
    label = F.log1p("label") if log1p else F.col("label")
    sums = expanding(gram_sums(folded, columns, segment_of(), label), len(columns.names), n_splits + 1)
    medians = expanding_medians(folded, columns.numeric, segment_of(), n_splits + 1)
    return {(c, k): solve(sums[k], columns, medians[k], float(p.get("alpha", 1.0)), float(p.get("l1_ratio", 0.5)), log1p)
            for c, p in enumerate(candidates) for k in range(n_splits + 1)}
