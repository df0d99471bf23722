"""Mixing documents to target domain weights through soft memberships.

A softmax classifier on hashed words, trained on a labelled table, gives every
document a posterior over the domains.  Document i with n_i tokens and posterior p_i adds
r_i n_i p_i to the expected domain totals.  Rates start at 1, and projected
gradient steps on the least squares distance to the target totals move them, each clipped to
[min_rate, max_rate] with min_rate >= 0:  r <- clip(r - p_i . M (T - t)).  With M the inverse of
sum n_i p_i p_i' over all documents a step never moves away; with the sum over those documents alone that the last
step did not clip, it would reach the targets if no other were clipped now, so that a few such steps suffice.  One pass over a narrow
table measures the totals T and that sum for several lengths of both steps, and the best is
taken; the step vectors so far are replayed on every row, so rates are never collected.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.common import id_and_text, lowest_hash, materialise, slices, tidy
from docket.llm.hashing import word_cache

BITS = 14
SAMPLE_DOCS = 4_000  # labelled rows the classifier is fitted on
RARE_DOCS = 100  # rows of every wanted domain that are added, so that a rare one is learned too
DOMAINS = 200  # the most frequent labels are learned, and all wanted ones
PASSES = 60  # passes over the memberships after which the nearest totals so far are taken
TOLERANCE = 1e-3  # of every target total
LENGTHS, SAFE_LENGTHS = (1.0, 0.6, 0.3, 0.1), (1.0, 4.0, 16.0)  # of the two kinds of step, measured in one pass


def word_vectors(texts: list[str | None], cache) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, bucket, value of unit length from square-rooted counts) and the number of words per text."""
    split = [t.lower().encode("utf-8", "replace").split() if t else [] for t in texts]
    size = np.array([len(s) for s in split], dtype=np.int64)
    hashed = np.fromiter((cache[w] for s in split for w in s), dtype=np.uint64, count=int(size.sum()))
    key, count = np.unique(np.repeat(np.arange(len(texts)), size) << BITS | (hashed >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    row, value = key >> BITS, np.sqrt(count)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=len(texts)))
    return row, key & ((1 << BITS) - 1), value / norm[row], size


@dataclass
class Classifier:
    """Softmax weights (bucket, domain) and biases."""

    domains: list[str]
    weight: np.ndarray
    bias: np.ndarray

    def posteriors(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = np.stack([np.bincount(row, weights=value * self.weight[bucket, k], minlength=n) for k in range(len(self.domains))], axis=1) + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(row, bucket, value, y: np.ndarray, domains: list[str], steps: int = 60, rate: float = 0.3, l2: float = 1e-5) -> Classifier:
    """Softmax regression by Adam over all sampled rows."""
    k, n = len(domains), len(y)
    c = Classifier(domains, np.zeros((1 << BITS, k)), np.log(np.bincount(y, minlength=k) / n + 1e-9))
    goal = np.eye(k)[y]
    m, v = np.zeros_like(c.weight), np.zeros_like(c.weight)
    for t in range(1, steps + 1):
        d = (c.posteriors(row, bucket, value, n) - goal) / n
        g = np.stack([np.bincount(bucket, weights=value * d[row, j], minlength=1 << BITS) for j in range(k)], axis=1) + l2 * c.weight
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        c.weight -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return c


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = word_cache()
    for b in batches:
        for piece in slices(b):
            row, bucket, value, _ = word_vectors(piece.column("text").to_pylist(), cache)
            at = np.searchsorted(row, np.arange(piece.num_rows + 1))
            yield pa.RecordBatch.from_arrays([piece.column("domain"), pa.array([bucket[x:y].astype(np.int32).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                                              pa.array([value[x:y].astype(np.float32).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                                             ["domain", "buckets", "vals"])


def fit(labelled: DataFrame, id_col: str, text_col: str, domain_col: str, wanted: Iterable[str] = ()) -> Classifier | None:
    """Classifier from the rows of ``labelled`` with a text and a domain; None without any.

    At most ``SAMPLE_DOCS`` rows with the lowest hash of the id are learned from, and of each ``wanted`` domain the ``RARE_DOCS`` with the lowest.
    """
    rows = labelled.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                           F.col(f"`{domain_col}`").cast("string").alias("domain")).filter("text IS NOT NULL AND domain IS NOT NULL")
    wanted = sorted(wanted)
    chosen = lowest_hash(rows.select("doc_id", "domain"), SAMPLE_DOCS, "doc_id", "domain")
    lowest = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id", "domain"), "doc_id")
    rare = rows.select("doc_id", "domain").filter(F.col("domain").isin(wanted)).withColumn("r", F.row_number().over(lowest)).filter(F.col("r") <= RARE_DOCS)
    chosen = chosen.unionByName(rare.drop("r")).distinct()
    # bounded: SAMPLE_DOCS ids and RARE_DOCS a wanted domain
    sample = rows.join(F.broadcast(materialise(chosen, "mix-sample")), ["doc_id", "domain"], "left_semi").select("domain", "text")
    got = sample.mapInArrow(tidy(_sparse), "domain string, buckets binary, vals binary").collect()
    names = [r["domain"] for r in got]
    count = Counter(names)
    domains = sorted({*sorted(count, key=lambda d: (-count[d], d))[:DOMAINS], *(d for d in wanted if d in count)})
    got = [r for r in got if r["domain"] in set(domains)]
    if not got:
        return None
    ids = [np.frombuffer(r["buckets"], dtype=np.int32) for r in got]
    row = np.repeat(np.arange(len(got)), [len(x) for x in ids])
    value = np.concatenate([np.frombuffer(r["vals"], dtype=np.float32) for r in got]).astype(float)
    return train(row, np.concatenate(ids), value, np.array([domains.index(r["domain"]) for r in got]), domains)


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th (xxhash64 of the text), n_tokens (words), p array<double>`` per row; a text without words has the prior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, k = word_cache(), len(model.domains)
        for b in batches:
            for piece in slices(b):
                row, bucket, value, size = word_vectors(piece.column("text").to_pylist(), cache)
                p = model.posteriors(row, bucket, value, piece.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("th"), pa.array(size),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.reshape(-1)))], ["doc_id", "th", "n_tokens", "p"])

    rows = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).select("doc_id", "th", "text")
    return rows.mapInArrow(tidy(run), "doc_id bigint, th bigint, n_tokens bigint, p array<double>")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return pc.list_flatten(b.column("p")).to_numpy().reshape(b.num_rows, -1)


def _rates(p: np.ndarray, steps: np.ndarray, low: float, high: float) -> np.ndarray:
    """Replay the steps from rate 1."""
    r = np.clip(np.ones(len(p)), low, high)
    for s in steps:
        r = np.clip(r - p @ s, low, high)
    return r


def _totals(steps: np.ndarray, choices: np.ndarray, low: float, high: float):
    """For every choice of the next step: the expected domain totals after it, and sum n p p' of the rows that it does not clip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                p, n = _matrix(b), b.column("n_tokens").to_numpy().astype(float)
                add = _choice_totals(p, n, steps, choices, low, high)
                total = add if total is None else total + add
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])

    return run


def _choice_totals(p: np.ndarray, n: np.ndarray, steps: np.ndarray, choices: np.ndarray, low: float, high: float) -> np.ndarray:
    r, parts = _rates(p, steps, low, high), []
    for c in choices:
        ahead = r - p @ c
        free = (ahead >= low) & (ahead <= high)
        parts += [(np.clip(ahead, low, high) * n) @ p, ((p[free] * n[free, None]).T @ p[free]).reshape(-1)]
    return np.concatenate(parts)


def _measure(table: DataFrame, steps: np.ndarray, choices: np.ndarray, low: float, high: float) -> np.ndarray | None:
    c, k = choices.shape
    rows = table.mapInArrow(_totals(steps, choices, low, high), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # c (k + k^2) rows
    if not rows:
        return None
    out = np.zeros(c * (k + k * k))
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def fit_steps(table: DataFrame, weights: np.ndarray, total: float | str | None, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projected-gradient steps on the memberships ``table``: step vectors, target totals, totals reached.

    ``total`` is the number of tokens wanted, or ``natural`` for as many as there are; None takes the fewest for which no domain has to
    shrink, and more if memberships in several domains lift one beyond its target.  Every pass measures a few lengths of both
    kinds of step and takes the one that ends nearest.  Ends when every total is within ``TOLERANCE``, when no step
    comes nearer (the problem is convex, so these are the nearest totals within the bounds), or after ``PASSES`` passes.
    """
    k = len(weights)
    steps = np.zeros((0, k))

    def measure(choices: np.ndarray, low: float, high: float) -> list[tuple[np.ndarray, np.ndarray]] | None:
        got = _measure(table, steps, choices, low, high)
        return None if got is None else [(x[:k], x[k:].reshape(k, k)) for x in got.reshape(len(choices), -1)]

    first = measure(np.zeros((1, k)), 1.0, 1.0)
    if first is None or not first[0][0].sum():
        return steps, np.zeros(k), np.zeros(k)
    now, gram = first[0]
    wanted, grows = weights > 0, total is None
    if total is None:
        total = float((now[wanted] / weights[wanted]).max())
    target = weights * (now.sum() if total == "natural" else float(total))
    ridge = 1e-9 * np.trace(gram) / k * np.eye(k)
    safe = np.linalg.pinv(gram + ridge)
    for _ in range(PASSES):
        gap = now - target
        if (np.abs(gap) <= TOLERANCE * np.maximum(target, 1.0)).all():
            break
        choices = np.outer(LENGTHS, np.linalg.pinv(gram + ridge) @ gap)
        choices = np.concatenate([choices, np.outer(SAFE_LENGTHS, safe @ gap)])
        after = measure(choices, low, high)
        far = [(t - target) @ safe @ (t - target) for t, _ in after]
        best = int(np.argmin(far))
        if far[best] < 0.995 * (gap @ safe @ gap):
            steps, (now, gram) = np.vstack([steps, choices[best]]), after[best]
        elif grows and (over := float((now[wanted] / target[wanted]).max())) > 1 + TOLERANCE:
            target = target * (2 * over - 1)
        else:
            break
    return steps, target, now


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *args, **kw) -> DataFrame:
    """The rates of ``plan``; a domain total off its target is warned about."""
    rated, totals = plan(docs, labelled, weights, *args, **kw)
    if missed := missed_totals(totals):
        warnings.warn(f"mix within the bounds only nearest to the wanted totals (domain, target, reached): {missed}", stacklevel=2)
    return rated


def missed_totals(totals: list[tuple[str, float, float]]) -> list[tuple[str, float, float]]:
    """The (domain, target, reached) that are off by more than the tolerance."""
    return [(d, t, x) for d, t, x in totals if abs(x - t) > TOLERANCE * max(t, 1.0)]


def plan(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang",
        total: float | str | None = None, min_rate: float = 0.0, max_rate: float = float("inf")) -> tuple[DataFrame, list[tuple[str, float, float]]]:
    """``doc_id, th, n_tokens, domain, posterior, rate, copies`` for every row of ``docs``; and (domain, target total, total reached).

    ``weights`` are the wanted shares of the domains (normalised here); labels
    that it does not name get none, names without labelled rows reach 0 tokens, the others keep their shares.  ``domain`` is the
    likeliest domain (ties to the first by name).  ``copies`` rounds the rate to a neighbouring whole number
    by a hash of id and text, so that its expectation is the rate.  A
    NULL, empty or blank text has 0 tokens and rate 1 (within the bounds).  Rows are independent,
    so repeated rows get equal rates.  Without labelled rows every document has rate 1; an
    empty table gives an empty result.  Other columns are ignored.
    """
    if min_rate < 0 or max_rate < max(min_rate, 1.0) or min_rate > 1.0:
        raise ValueError("0 <= min_rate <= 1 <= max_rate is needed")
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be nonnegative and not all zero")
    wanted = [d for d, w in weights.items() if w > 0]
    model = fit(labelled, id_col, text_col, domain_col, wanted)
    if model is None:
        model = Classifier([""], np.zeros((1 << BITS, 1)), np.zeros(1))
    whole = sum(weights.values())
    share = np.array([weights.get(d, 0.0) / whole for d in model.domains])
    table = materialise(memberships(docs, model, id_col, text_col), "memberships")
    steps, target, reached = (fit_steps(table, share, total, min_rate, max_rate) if share.sum() > 0
                              else (np.zeros((0, len(share))), np.zeros(0), np.zeros(0)))
    totals = [(d, float(t), float(x)) for d, t, x in zip(model.domains, target, reached)]
    asked = float(target.sum() / share.sum()) if len(target) else 0.0
    totals += [(d, asked * weights[d] / whole, 0.0) for d in sorted(set(wanted) - set(model.domains))]  # no row to learn them from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.domains, dtype=object)
        for b in batches:
            if b.num_rows:
                p, n = _matrix(b), b.column("n_tokens").to_numpy()
                r = np.where(n > 0, _rates(p, steps, min_rate, max_rate), 1.0)
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), b.column("n_tokens"), pa.array(names[best], pa.string()),
                                                  pa.array(p[np.arange(len(p)), best]), pa.array(r)], ["doc_id", "th", "n_tokens", "domain", "posterior", "rate"])

    rated = table.mapInArrow(tidy(run), "doc_id bigint, th bigint, n_tokens bigint, domain string, posterior double, rate double")
    u = F.pmod(F.xxhash64("doc_id", "th", F.lit("copies")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rated.withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")), totals


def sample(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as its ``copies`` say; columns unchanged."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"doc_id": F.col("row")[id_col].cast("bigint"), "th": F.xxhash64(F.col("row")[text_col].cast("string"))})
    some = rated.select("doc_id", "th", "copies").distinct().filter("copies > 0")
    joined = rows.join(some, rows["doc_id"].eqNullSafe(some["doc_id"]) & (rows["th"] == some["th"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")
