"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of each white-space-delimited word in both
directions (its state starts anew with every word, so equal words are labelled
once per task), gives every byte position a distribution over the languages, and a
document's distribution is the mean over all positions of its whole text.
Training is plain numpy: backpropagation through time and Adam, on words of a
bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import lowest_hash, materialise, slices, tidy

HIDDEN = 16
PIECE = 24  # bytes read in one go; a longer word is read in pieces
SAMPLE_DOCS = 2_000  # training documents per language, lowest hash of the id first
LANGUAGES = 100  # the most frequent languages are learned
SAMPLE_WORDS = 64  # words taken from each, evenly spread over its text
STEPS, BATCH = 500, 1024
WORDS_KEPT = 150_000  # words whose labels a task remembers at once
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def pad(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (time, word) and lengths."""
    lengths = np.array([len(w) for w in words])
    out = np.zeros((len(words), max(1, lengths.max(initial=1))), dtype=np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return out.T, lengths


def _mirror(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Reverse every word of (time, word, ...) within its own length."""
    t = np.arange(len(x))[:, None]
    src = np.where(t < lengths, lengths - 1 - t, t)
    return x[src, np.arange(x.shape[1])]


@dataclass
class Network:
    """``table``: input weights by direction and byte (2, 256, 3H); ``u``: recurrent (2, H, 3H); ``out``: (2H, K)."""

    table: np.ndarray
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    langs: list[str]

    def params(self) -> list[np.ndarray]:
        return [self.table, self.u, self.out, self.bias]

    def _direction(self, d: int, x: np.ndarray, keep: bool):
        """Gated recurrence over (time, word) bytes; gates are kept for backpropagation."""
        table, u, hid = self.table[d], self.u[d], self.u.shape[1]
        h = np.zeros((x.shape[1], hid), dtype=table.dtype)
        states, gates = [], []
        for xt in x:
            a, g = table[xt], h @ u
            zr = _sigmoid(a[:, :2 * hid] + g[:, :2 * hid])
            z, r = zr[:, :hid], zr[:, hid:]
            n = np.tanh(a[:, 2 * hid:] + r * g[:, 2 * hid:])
            if keep:
                gates.append((h, z, r, n, g[:, 2 * hid:]))
            h = n + z * (h - n)
            states.append(h)
        return np.array(states), gates

    def positions(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Probabilities (time, word, language) of every byte position."""
        fwd, gf = self._direction(0, x, keep)
        bwd, gb = self._direction(1, _mirror(x, lengths), keep)
        both = np.concatenate([fwd, _mirror(bwd, lengths)], axis=2)
        logit = both @ self.out + self.bias
        e = np.exp(logit - logit.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), (both, gf, gb)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Loss and gradients of the weighted mean cross-entropy over all positions."""
        p, (both, gf, gb) = self.positions(x, lengths, keep=True)
        hid = self.u.shape[1]
        mask = (np.arange(len(x))[:, None] < lengths) * weight
        mask = (mask / mask.sum()).astype(p.dtype)
        words = np.arange(x.shape[1])
        loss = -float((mask * np.log(p[:, words, target] + 1e-12)).sum())
        d = p.copy()
        d[:, words, target] -= 1
        d *= mask[:, :, None]
        g_out, g_bias = np.einsum("tbh,tbk->hk", both, d), d.sum(axis=(0, 1))
        d_both = d @ self.out.T
        g_table, g_u = np.zeros_like(self.table), np.zeros_like(self.u)
        for k, (gates, xs, dh_all) in enumerate(((gf, x, d_both[:, :, :hid]),
                                                 (gb, _mirror(x, lengths), _mirror(d_both[:, :, hid:], lengths)))):
            u, carry = self.u[k], np.zeros((x.shape[1], hid), dtype=p.dtype)
            for t in range(len(x) - 1, -1, -1):
                h, z, r, n, gn = gates[t]
                dh = dh_all[t] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)  # into the input side
                dg = np.concatenate([dz, dr, dn * r], axis=1)  # into the recurrent side
                g_u[k] += h.T @ dg
                np.add.at(g_table[k], xs[t], da)
                carry = dh * z + dg @ u.T
        return loss, [g_table, g_u, g_out, g_bias]


def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 7, dtype=np.float32) -> Network:
    rng = np.random.default_rng(seed)
    k = len(langs)
    return Network((rng.normal(size=(2, 256, 3 * hidden)) * 0.3).astype(dtype), (rng.normal(size=(2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(dtype),
                   (rng.normal(size=(2 * hidden, k)) * 0.3).astype(dtype), np.zeros(k, dtype=dtype), langs)


def train(words: list[bytes], lang: np.ndarray, count: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on batches of words drawn by their counts; every language weighs the same."""
    net, rng = fresh(langs, seed=seed), np.random.default_rng(seed)
    per_lang = np.bincount(lang, weights=count, minlength=len(langs))
    weight = (1 / per_lang[lang]).astype(np.float64)
    share = np.cumsum(count * weight)
    share /= share[-1]
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for t in range(1, steps + 1):
        pick = np.searchsorted(share, rng.random(BATCH))
        x, lengths = pad([words[i] for i in pick])
        _, grads = net.gradients(x, lengths, lang[pick], np.ones(len(pick)))
        rate = 0.02 * min(1.0, 2 * (1 - t / (steps + 1)))
        for i, (p, g) in enumerate(zip(net.params(), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-7)).astype(p.dtype)
    return net


def pieces(word: str) -> list[bytes]:
    """The bytes of a word, cut every ``PIECE`` bytes."""
    raw = word.encode("utf-8", "replace")
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Labeller:
    """Sums of position probabilities per word, remembered for up to ``WORDS_KEPT`` words."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self):
        self.index: dict[str, int] = {}
        self.sums = np.zeros((WORDS_KEPT, len(self.net.langs) + 1), dtype=np.float32)

    def learn(self, words: list[str]):
        """Label new words, short ones first so that a batch holds words of like length."""
        todo = [(p, i) for i, w in enumerate(words) if has_letter(w) for p in pieces(w)]
        todo.sort(key=lambda x: len(x[0]))
        rows = np.zeros((len(words), self.sums.shape[1]), dtype=np.float32)
        for at in range(0, len(todo), 2048):
            part = todo[at:at + 2048]
            x, lengths = pad([p for p, _ in part])
            p, _ = self.net.positions(x, lengths)
            p = p * (np.arange(len(x))[:, None] < lengths)[:, :, None]
            np.add.at(rows, np.array([i for _, i in part]), np.column_stack([p.sum(axis=0), lengths]).astype(np.float32))
        return rows

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Per text the summed position probabilities and the number of positions."""
        split = [t.lower().split() if t else [] for t in texts]
        out = np.zeros((len(texts), self.sums.shape[1]))
        seen = {w for s in split for w in s}
        new = [w for w in seen if w not in self.index]
        if len(self.index) + len(new) > WORDS_KEPT:
            self.reset()
            new = list(seen)
        if len(new) > WORDS_KEPT:  # one text with more distinct words than are remembered
            for i, s in enumerate(split):
                count = Counter(s)
                keys = list(count)
                for at in range(0, len(keys), WORDS_KEPT):
                    part = keys[at:at + WORDS_KEPT]
                    out[i] += np.array([count[w] for w in part]) @ self.learn(part).astype(np.float64)
            return out
        start = len(self.index)
        if new:
            self.sums[start:start + len(new)] = self.learn(new)
            self.index.update(zip(new, range(start, start + len(new)), strict=True))
        ends = np.cumsum([len(s) for s in split])
        ids = np.fromiter((self.index[w] for s in split for w in s), dtype=np.int64, count=int(ends[-1]) if len(ends) else 0)
        full = np.flatnonzero([len(s) > 0 for s in split])
        if len(full):
            starts = (ends - [len(s) for s in split])[full]
            out[full] = np.add.reduceat(self.sums[ids].astype(np.float64), starts, axis=0)
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", steps: int = STEPS) -> Network | None:
    """Train on the rows of ``docs`` with a language and a text; None without such rows.

    At most ``SAMPLE_DOCS`` documents a language and ``SAMPLE_WORDS`` words of each are used.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                        F.col(f"`{text_col}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    names = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    if not names:
        return None
    parts = [lowest_hash(known.filter(F.col("lang") == x).select("doc_id", "lang"), SAMPLE_DOCS, "doc_id") for x in names]
    chosen = reduce(DataFrame.unionByName, parts)
    # bounded: SAMPLE_DOCS ids a language
    sample = known.join(F.broadcast(materialise(chosen, "lang-sample")), ["doc_id", "lang"], "left_semi")
    words = sample.select("lang", "text").mapInArrow(_spread, "lang string, word binary, n bigint")
    rows = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").collect()
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    return train([bytes(r["word"]) for r in rows], np.array([langs.index(r["lang"]) for r in rows]), np.array([r["n"] for r in rows], dtype=float), langs, steps)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words spread evenly over each sampled text."""
    for b in batches:
        count: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = text.lower().split()
            for i in np.unique(np.linspace(0, len(words) - 1, min(len(words), SAMPLE_WORDS)).astype(int)) if words else []:
                if has_letter(words[i]):
                    count.update((lang, p) for p in pieces(words[i]))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.binary()),
                                          pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``.

    A text that is NULL or has no letter is ``und`` with score 0, as is every
    text when nothing was learned.  The score is the mean probability of the
    predicted language over all byte positions of words with a letter; ties go to the language that sorts
    first.  Rows are independent: repeated rows and ids stay, other columns are ignored.
    """
    if net is None:
        net = fresh([UNDETERMINED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net)
        for b in batches:
            for piece in slices(b):
                sums = labeller.documents(piece.column("text").to_pylist())
                n = sums[:, -1]
                mean = sums[:, :-1] / np.maximum(n, 1)[:, None]
                best = mean.argmax(axis=1)
                lang = [net.langs[k] if m else UNDETERMINED for k, m in zip(best, n, strict=True)]
                s = np.where([x == UNDETERMINED for x in lang], 0.0, np.clip(mean[np.arange(len(n)), best], 0, 1))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lang, pa.string()), pa.array(s)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        tidy(run), "doc_id bigint, lang_pred string, score double")
