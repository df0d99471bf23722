"""Toxicity scores: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams (bytes of the lower-cased
text with white space runs as one space, n from ``ORDERS``) hashed to ``BUCKETS``.  From labelled
rows every bucket gets its smoothed log ratio of document frequencies (toxic
against clean); the most significant buckets stay, and logistic regression is
trained on presence times ratio.  Scoring is one pass over the text without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import id_and_text, lowest_hash, materialise, slices, tidy

ORDERS = (3, 4, 5)
BITS = 20
BUCKETS = 1 << BITS
FEATURES = 2048  # buckets kept for the linear model
SAMPLE = {1: 6_000, 0: 12_000}  # labelled rows per class the model is fitted on
SAMPLE_TASKS = 16
CHUNK = 500_000  # characters handled at once: every position has three buckets
SMOOTHING = 1.0


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each order: the bucket at every position of the joined texts, with the start offsets of the texts."""
    raw = [(" " + " ".join(t.lower().split()) + " ").encode("utf-8", "replace") if t and not t.isspace() else b"" for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    h = data
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) + data[n - 1:]
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            mixed ^= mixed >> np.uint32(13)
            mixed *= np.uint32(0xC2B2AE35)
            yield mixed >> np.uint32(32 - BITS), starts, n


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; ``wanted`` is a flag per bucket, None takes all."""
    keys = []
    for bucket, starts, n in grams(texts):
        at = np.flatnonzero(wanted[bucket]) if wanted is not None else np.arange(len(bucket))
        row = np.searchsorted(starts, at, side="right") - 1
        inside = at + n <= starts[row + 1]  # not across two texts
        keys.append(row[inside].astype(np.int64) << BITS | bucket[at[inside]])
    key = np.unique(np.concatenate(keys)) if keys else np.empty(0, dtype=np.int64)
    return key >> BITS, key & (BUCKETS - 1)


@dataclass
class Model:
    weight: np.ndarray  # float32 per bucket: logistic weight times log-count ratio
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        row, bucket = features(texts, self.weight != 0)
        z = self.bias + np.bincount(row, weights=self.weight[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency of every bucket by class, as 16 slices per task."""
    total = np.zeros((2, BUCKETS), dtype=np.int32)
    rows = np.zeros(2, dtype=np.int64)
    for b in batches:
        for piece in slices(b, chars=CHUNK):
            label = piece.column("label").to_numpy()
            row, bucket = features(piece.column("text").to_pylist())
            for c in (0, 1):
                total[c] += np.bincount(bucket[label[row] == c], minlength=BUCKETS).astype(np.int32)
                rows[c] += int((label == c).sum())
    if rows.any():
        parts = total.reshape(2, 16, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(16, dtype=np.int32)), pa.array([parts[:, i].tobytes() for i in range(16)], pa.binary()),
             pa.array([int(rows[0])] * 16), pa.array([int(rows[1])] * 16)], ["part", "counts", "clean", "toxic"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, part, clean, toxic = None, None, 0, 0
    for b in batches:
        for i in range(b.num_rows):
            x = np.frombuffer(b.column("counts")[i].as_py(), dtype=np.int32)
            total = x.astype(np.int64) if total is None else total + x
            part, clean, toxic = b.column("part")[i].as_py(), clean + b.column("clean")[i].as_py(), toxic + b.column("toxic")[i].as_py()
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([clean]), pa.array([toxic])],
                                     ["part", "counts", "clean", "toxic"])


def _select(df: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most significant buckets and their log-count ratios (an unseen bucket has ratio 0)."""
    share = n / n.sum()
    p = [(df[c] + SMOOTHING * share[c]) / (n[c] + SMOOTHING * share[c]) for c in (0, 1)]
    ratio = np.log(p[1]) - np.log(p[0])
    odds = [np.log((df[c] + 0.5) / (n[c] - df[c] + 0.5)) for c in (0, 1)]
    error = np.sqrt(sum(1 / (df[c] + 0.5) + 1 / (n[c] - df[c] + 0.5) for c in (0, 1)))
    z = np.abs(odds[1] - odds[0]) / error
    z[df.sum(axis=0) < 3] = 0
    best = np.lexsort((np.arange(BUCKETS), -z))[:FEATURES]
    best = np.sort(best[z[best] > 1])
    return best, ratio[best]


def _logistic(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 150,
              rate: float = 0.1, chunk: int = 1000) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Adam over the whole sample; ``rows`` hold the features present, each with value ``scale``.

    Rows are gone through in chunks, so that little beside the features themselves is in memory.
    """
    k = len(scale)
    parts = []
    for at in range(0, len(rows), chunk):
        part = rows[at:at + chunk]
        parts.append((slice(at, at + len(part)), np.concatenate(part).astype(np.int16), np.array([len(r) for r in part])))
    w = np.zeros(k + 1)
    w[k] = np.log((weight[y == 1].sum() + 1e-9) / (weight[y == 0].sum() + 1e-9))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        grad = np.zeros(k + 1)
        for at, col, size in parts:
            sums = np.concatenate([[0.0], np.cumsum((w[:k] * scale)[col])])
            ends = np.cumsum(size)
            z = sums[ends] - sums[ends - size] + w[k]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at]
            grad[:k] += np.bincount(col, weights=np.repeat(g, size), minlength=k) * scale
            grad[k] += g.sum()
        grad /= weight.sum()
        grad[:k] += l2 * w[:k]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:k], float(w[k])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on ``docs`` joined with ``labels`` (id, 0/1 label; other labels are ignored, a repeated id counts once, as 1 if any of its rows is 1).

    At most ``SAMPLE`` rows of each class are used, those with the lowest hash
    of the id; their weights restore the class shares of all labelled rows.
    Without rows of both classes every score is the share of label 1 (0 without labels).
    """
    lab = (labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
           .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label")))
    n = {r["label"]: r["count"] for r in lab.groupBy("label").count().collect()}
    if len(n) < 2:
        share = 1.0 if 1 in n else 0.0
        return Model(np.zeros(BUCKETS, dtype=np.float32), 500.0 if share else -500.0)
    pick = [lowest_hash(lab.filter(F.col("label") == c), SAMPLE[c], "doc_id") for c in (0, 1)]
    # bounded by SAMPLE: 18,000 rows of two numbers
    train = (id_and_text(docs, id_col, text_col).join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id")
             .select("label", F.coalesce("text", F.lit("")).alias("text")))
    train = materialise(train, "toxic-train").repartition(SAMPLE_TASKS)
    schema = "part int, counts binary, clean bigint, toxic bigint"
    parts = train.mapInArrow(tidy(_count), schema).groupBy("part").applyInArrow(_sum, schema).orderBy("part").collect()
    if not parts:
        return Model(np.zeros(BUCKETS, dtype=np.float32), -500.0)
    df = np.concatenate([np.frombuffer(r["counts"], dtype=np.int64).reshape(2, -1) for r in parts], axis=1)
    rows = np.array([parts[0]["clean"], parts[0]["toxic"]])
    if not rows.all():
        return Model(np.zeros(BUCKETS, dtype=np.float32), 500.0 if rows[1] else -500.0)
    best, ratio = _select(df, rows)
    wanted = np.zeros(BUCKETS, dtype=bool)
    wanted[best] = True
    sparse = train.mapInArrow(tidy(_sparse(wanted)), "label int, buckets binary").toArrow()  # at most SAMPLE rows of feature numbers
    y = sparse.column("label").to_numpy().astype(float)
    present = [np.searchsorted(best, np.frombuffer(x.as_py(), dtype=np.int32)).astype(np.int16) for x in sparse.column("buckets")]
    del sparse
    share = np.array([n[0], n[1]]) / rows
    w, bias = _logistic(present, ratio, y, share[y.astype(int)])
    weight = np.zeros(BUCKETS, dtype=np.float32)
    weight[best] = w * ratio
    return Model(weight, bias)


def _sparse(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, chars=CHUNK):
                row, bucket = features(piece.column("text").to_pylist(), wanted)
                cuts = np.searchsorted(row, np.arange(piece.num_rows + 1))
                ids = bucket.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("label"), pa.array([ids[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    ["label", "buckets"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``.

    A NULL, empty or blank text has no features and gets the score of the bias alone.
    Every row is scored on its own, so repeated rows and ids stay as they are;
    whole texts of any length are read; other columns are ignored.
    """
    return _scored(id_and_text(docs, id_col, text_col), "text", model, ["doc_id"])


def flag(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (struct of all columns of ``docs``), ``score``, ``predicted``; otherwise as ``score``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _scored(rows, "text", model, ["row"])


def _scored(rows: DataFrame, text_col: str, model: Model, keep: list[str]) -> DataFrame:
    kept = np.flatnonzero(model.weight)
    small = (kept, model.weight[kept], model.bias)  # at most FEATURES numbers travel to the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(BUCKETS, dtype=np.float32)
        weight[small[0]] = small[1]
        local = Model(weight, small[2])
        for b in batches:
            for piece in slices(b, text_col, CHUNK):
                s = local.scores(piece.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                                 [*keep, "score", "predicted"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(tidy(run), f"{kinds}, score double, predicted int")
