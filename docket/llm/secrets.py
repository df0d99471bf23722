"""Secret scans: pattern rules plus a character convolutional network over every candidate.

The rules give the base spans.  A candidate is a run of token characters of
``CANDIDATE`` or more characters; the network reads its characters and the text around
it, a long one in overlapping windows of which the best counts.  It is trained on findings of a bounded sample of documents (candidates that a rule marks against
the others; half of the training windows hide the left context, so that the
shape of the string counts as well), its logits are calibrated on held-out findings with the left context
hidden, and the threshold is the largest that keeps the wanted recall there.  Spans
above it that touch no base span are added as kind ``net``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import id_and_text, lowest_hash, materialise, slices, tidy

# The rules, their least lengths and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "net")
WORDS = ("password", "passwd", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEFT, BODY, RIGHT = 24, 40, 8  # characters of a window
WIDTH = LEFT + BODY + RIGHT
SAMPLE_DOCS = 30_000  # documents whose findings train the network
SAMPLE_FINDINGS = 4_000  # distinct windows of each class
RECALL = 0.95
FILTERS, SPAN, EMBED, DENSE = 24, 5, 10, 16

#: Character classes: 0 padding, 1 other, then the printable ASCII characters.
CODES = np.ones(0x110000, dtype=np.uint8)
CODES[32:127] = np.arange(2, 97)
CODES[0] = 0
N_CODES = 97


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the rules' spans, sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):  # spares the costly pattern where none of its words occurs
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # the maximal runs of HEX that are long enough


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def cuts(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a candidate that fit a window: half overlapping ones if it is long, the last up to its end."""
    if end - start <= BODY:
        return [(start, end)]
    return [(s, s + BODY) for s in [*range(start, end - BODY, BODY // 2), end - BODY]]


def window(text: str, start: int, end: int) -> str:
    """Left context, the part of a candidate (``BODY`` characters at most) and right context, filled up with NUL."""
    end = min(end, start + BODY)
    left = text[max(0, start - LEFT):start].rjust(LEFT, "\0")
    body = text[start:end]
    return left + body.ljust(BODY, "\0") + text[end:end + RIGHT].ljust(RIGHT, "\0")


def codes(windows: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(windows).encode("utf-32-le", "replace"), dtype=np.uint32)
    return CODES[points].reshape(len(windows), WIDTH)


@dataclass
class Network:
    """Embedding, one convolution with max pooling, a dense layer and a logit; ``a``, ``b`` calibrate it."""

    params: list[np.ndarray]
    a: float = 1.0
    b: float = 0.0
    threshold: float = 2.0  # nothing is added unless fitted

    def forward(self, x: np.ndarray):
        emb, w, c, w1, c1, w2, c2 = self.params
        e = emb[x]
        cols = np.concatenate([e[:, i:WIDTH - SPAN + 1 + i] for i in range(SPAN)], axis=2)
        z = cols @ w + c
        top = z.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(z, top[:, None], axis=1)[:, 0], 0)
        hidden = np.maximum(pooled @ w1 + c1, 0)
        return hidden @ w2 + c2, (cols, top, pooled, hidden)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Loss and gradients of the weighted mean cross-entropy."""
        emb, w, c, w1, c1, w2, c2 = self.params
        logit, (cols, top, pooled, hidden) = self.forward(x)
        p = 1 / (1 + np.exp(-np.clip(logit[:, 0], -30, 30)))
        share = weight / weight.sum()
        loss = -float((share * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum())
        d = ((p - y) * share)[:, None]
        g_w2, g_c2 = hidden.T @ d, d.sum(axis=0)
        dh = d @ w2.T * (hidden > 0)
        g_w1, g_c1 = pooled.T @ dh, dh.sum(axis=0)
        dp = dh @ w1.T * (pooled > 0)
        n = np.arange(len(x))[:, None]
        picked = cols[n, top]  # (window, filter, inputs of the filter at its best place)
        g_w, g_c = np.einsum("nf,nfi->if", dp, picked), dp.sum(axis=0)
        back = dp[:, :, None] * w.T[None]
        g_emb = np.zeros_like(emb)
        for i in range(SPAN):
            np.add.at(g_emb, x[n, top + i], back[:, :, i * EMBED:(i + 1) * EMBED])
        return loss, [g_emb, g_w, g_c, g_w1, g_c1, g_w2, g_c2]

    def logits(self, windows: list[str]) -> np.ndarray:
        x = codes(windows)
        return np.concatenate([self.forward(x[i:i + 512])[0][:, 0] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def probabilities(self, windows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.logits(windows) + self.b, -500, 500)))


def fresh(seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    shapes = [(N_CODES, EMBED), (SPAN * EMBED, FILTERS), (FILTERS,), (FILTERS, DENSE), (DENSE,), (DENSE, 1), (1,)]
    return Network([rng.normal(size=s) * (0.5 if i == 0 else (2 / s[0]) ** 0.5) if len(s) > 1 else np.zeros(s) for i, s in enumerate(shapes)])


def train(windows: list[str], y: np.ndarray, epochs: int = 12, seed: int = 11, least: float = 0.5) -> Network:
    """Adam on three quarters of the findings; calibration and threshold (``least`` or more) on the other quarter."""
    rng = np.random.default_rng(seed)
    net, y = fresh(seed), y.astype(float)
    order = rng.permutation(len(y))
    held, rest = order[:len(y) // 4], order[len(y) // 4:]
    if y[held].sum() == 0 or y[rest].sum() == 0 or y[rest].sum() == len(rest):
        return net
    x = codes(windows)
    weight = np.where(y == 1, 0.5 / y[rest].mean(), 0.5 / (1 - y[rest].mean()))
    m, v, t = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params], 0
    for _ in range(epochs):
        for at in range(0, len(rest), 64):
            pick = rng.permutation(rest)[:64]
            xb = x[pick].copy()
            xb[rng.random(len(pick)) < 0.5, :LEFT] = 0  # the context is hidden from half of them
            _, grads = net.gradients(xb, y[pick], weight[pick])
            t += 1
            for i, (p, g) in enumerate(zip(net.params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p -= 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    # no rule word shows left of what the network is applied to
    hidden = ["\0" * LEFT + windows[i][LEFT:] for i in held]
    net.a, net.b = calibrate(net.logits(hidden), y[held])
    net.threshold = recall_threshold(net.probabilities(hidden), y[held], least=least)
    return net


def calibrate(logit: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic calibration with smoothed targets, by Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design, w = np.column_stack([logit, np.ones(len(logit))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, design.T @ (p - target) + 1e-6 * w), -2, 2)
    return float(w[0]), float(w[1])


def recall_threshold(p: np.ndarray, y: np.ndarray, recall: float = RECALL, least: float = 0.5) -> float:
    """The largest probability at or above which the wanted share of positives lies, at least ``least``."""
    positive = np.sort(p[y == 1])[::-1]
    return max(least, float(positive[int(np.ceil(recall * len(positive))) - 1]))


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled windows: does a rule mark the candidate, or at least half of a part of a long one?"""
    for b in batches:
        rows = set()
        for text in b.column("text").to_pylist():
            base = base_spans(text)
            for s, e in candidates(text):
                near = [(a, z) for a, _, z in base if a < e and s < z]
                for c, d in cuts(s, e):
                    marked = any(2 * (min(z, d) - max(a, c)) >= min(z - a, d - c) for a, z in near) if e - s > BODY else bool(near)
                    rows.add((window(text, c, d), int(marked)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["window", "label"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> Network:
    """Train on the findings of at most ``SAMPLE_DOCS`` documents (lowest hash of the id).

    A threshold below ``least`` is raised to it; 0 keeps the wanted recall whatever it takes.
    Equal windows count once; without findings of both classes nothing is ever added to the rules.
    """
    rows = id_and_text(docs, id_col, text_col).filter("text IS NOT NULL")
    chosen = lowest_hash(rows.select("doc_id"), SAMPLE_DOCS, "doc_id")
    # bounded: SAMPLE_DOCS ids
    found = (rows.join(F.broadcast(materialise(chosen, "secret-sample")), "doc_id", "left_semi").select("text")
             .mapInArrow(_findings, "window string, label int").groupBy("window").agg(F.max("label").alias("label")))
    found = materialise(found, "findings")
    part = lambda c: lowest_hash(found.filter(F.col("label") == c), SAMPLE_FINDINGS, "window").collect()
    sample = part(0) + part(1)
    return train([r["window"] for r in sample], np.array([r["label"] for r in sample], dtype=float), least=least) if sample else fresh()


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found array<struct<start, kind, end, secret>>``: every span of every row, sorted by start and kind.

    Offsets count code points, ends are exclusive.  NULL and empty texts have
    no spans.  Rows are independent: repeated rows and ids stay; texts of any
    length are read whole; other columns are ignored.
    """
    kind = "struct<start:bigint,kind:string,end:bigint,secret:string>"
    inner = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("secret", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                spans = [base_spans(t) for t in texts]
                open_ = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t) if not any(a < e and s < z for a, _, z in spans[i])]
                score = np.zeros(len(open_))  # of a candidate's parts the highest
                parts = ((k, c, d) for k, (_, s, e) in enumerate(open_) for c, d in cuts(s, e))
                while part := list(islice(parts, 4096)):
                    np.maximum.at(score, [k for k, _, _ in part], net.probabilities([window(texts[open_[k][0]], c, d) for k, c, d in part]))
                for (i, s, e), x in zip(open_, score, strict=True):
                    if x >= net.threshold:
                        spans[i].append((s, 3, e))
                out = [[{"start": s, "kind": KINDS[k], "end": e, "secret": t[s:e]} for s, k, e in sorted(sp)] for t, sp in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(out, pa.list_(inner))], ["doc_id", "found"])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), f"doc_id bigint, found array<{kind}>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text, from the result of ``scan``."""
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["kind"] != "net")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count("net"))


def text_digest(spans: list[tuple[int, int, int]]) -> str:
    """The base digest of one document, as ``digest`` gives it."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
