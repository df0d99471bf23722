"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

Merging by score has a local characterisation: a sequence of pieces is the
encoding of its text exactly when every two neighbours encode to themselves.
So the encodings of all prefixes can be followed from left to right.  A state
holds, for every place where a longer piece may still be under way, the trie
node reached, the piece that ends before that place, and the number of pieces
up to it relative to the number for the whole prefix.  Reading a character
gives the next state, and the transition is annotated with the number of tokens it
emits: the change of the prefix's count, which may be zero or negative when a
longer piece replaces shorter ones.  States are made when the text first needs
them and dropped all together beyond a bound; this never changes a count.

Text runs through the transducer in chunks side by side.  From the first place
where no piece can reach across (a space after a non-space, the start of a
text), a chunk's state map is constant; the head before it depends on the state
the chunk is entered with.  Composing the maps in a prefix scan gives every chunk its entry
state, and the heads are then run from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm import spm_model as S
from docket.llm.common import id_and_text, slices, tidy

CHUNK = 512  # characters of a chunk
MAX_STATES = 150_000  # states kept by a task
RESET = 0  # symbol between two texts; 1-4 are unknown characters of so many bytes
LIMIT = 4096


class Transducer:
    """Lazily determinised token counter of a SentencePiece BPE model with byte fallback."""

    def __init__(self, data: bytes):
        model = S.parse(data)
        if model.model_type != S.BPE or not model.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if model.charsmap or model.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        self.dummy_prefix = model.add_dummy_prefix
        self.score = {p: s for p, s, t in model.pieces if t == S.NORMAL}
        self.children: list[dict[str, int]] = [{}]  # trie of the pieces
        self.piece: list[str | None] = [None]
        inside = set()
        for p in self.score:
            inside.update(zip(p, p[1:], strict=False))
            node = 0
            for ch in p:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.piece.append(None)
                node = self.children[node][ch]
            self.piece[node] = p
        self.inside = inside  # neighbouring characters that some piece holds
        chars = sorted({ch for p in self.score for ch in p})
        self.chars = [""] * 5 + chars
        self.symbol = np.zeros(0x110001, dtype=np.int32)
        self.symbol[:0x80], self.symbol[0x80:0x800], self.symbol[0x800:0x10000], self.symbol[0x10000:0x110000] = 1, 2, 3, 4
        for i, ch in enumerate(chars, 5):
            self.symbol[ord(ch)] = i
        self.n_symbols = len(self.chars)
        # a character that no piece holds after another one starts anew, whatever came before
        after = {b for a, b in inside if a != b}
        self.starts = np.array([i < 5 or ch not in after for i, ch in enumerate(self.chars)])
        self.valid: dict[tuple[str, str], bool] = {}
        self.reset()

    # -- compilation ------------------------------------------------------
    def reset(self, keep: list[tuple] = ()):
        """Forget all transitions; ``keep`` are states that go on, numbered from 1."""
        self.states: list[tuple] = [((0, None, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        for s in keep:
            self._number(s)
        self.bound = max(MAX_STATES, 2 * len(self.states))
        self._table(1 << 16)

    def _table(self, size: int):
        self.slots = np.full(size, -1, dtype=np.int64)
        self.values = np.zeros(size, dtype=np.int64)  # next state << 16 | emitted + 2**15
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.filled = 0

    def _number(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def encode(self, text: str) -> list[str]:
        """Merge by score, leftmost first among equal scores."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def neighbours(self, a: str, b: str) -> bool:
        """Whether a and b, side by side, stay as they are."""
        known = self.valid.get((a, b))
        if known is None:
            if len(self.valid) > 200_000:
                self.valid.clear()
            known = self.valid[a, b] = self.encode(a + b) == [a, b]
        return known

    def step(self, state: int, sym: int) -> tuple[int, int]:
        """Compile one transition: next state and emitted tokens."""
        if sym == RESET:
            return 0, 0
        if sym < 5:
            return 0, sym  # one token per byte, and nothing reaches across
        ch, live, token, total = self.chars[sym], [], None, 0
        for node, before, rel in self.states[state]:  # longest first
            child = self.children[node].get(ch)
            if child is None:
                continue
            if node == 0 and before is not None and (before[-1], ch) not in self.inside:
                before = None
            p = self.piece[child]
            if token is None and (p is not None or node == 0) and (before is None or self.neighbours(before, p or ch)):
                token, total = p or ch, rel + (1 if p is not None else len(ch.encode()))
            if self.children[child]:
                live.append((child, before, rel))
        if token is None:
            raise AssertionError(f"no piece fits before {ch!r}")
        new = tuple((node, before, rel - total) for node, before, rel in live) + ((0, token, 0),)
        return self._number(new), total

    def _insert(self, keys: np.ndarray):
        if (self.filled + len(keys)) * 2 > len(self.slots):
            old = self.slots >= 0
            k, v = self.slots[old], self.values[old]
            size = len(self.slots)
            while (len(k) + len(keys)) * 2 > size:
                size *= 2
            self._table(size)
            for a, b in zip(k.tolist(), v.tolist(), strict=True):
                self._put(a, b)
        for key in keys.tolist():
            nxt, emitted = self.step(*divmod(key, self.n_symbols))
            self._put(key, nxt << 16 | emitted + 0x8000)

    def _put(self, key: int, value: int):
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.slots[at] >= 0:
            if self.slots[at] == key:
                return
            at = (at + 1) & (len(self.slots) - 1)
        self.slots[at], self.values[at] = key, value
        self.filled += 1

    # -- execution --------------------------------------------------------
    def advance(self, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One character for every chunk: next states and emitted counts."""
        while True:
            key = state * self.n_symbols + sym
            at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
            found = self.slots[at]
            wrong = np.flatnonzero(found != key)
            missing = wrong[found[wrong] < 0]
            wrong = wrong[found[wrong] >= 0]
            while len(wrong):  # another key holds the slot: look at the next one
                at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
                got = self.slots[at[wrong]]
                missing = np.concatenate([missing, wrong[got < 0]])
                wrong = wrong[(got >= 0) & (got != key[wrong])]
            if not len(missing):
                value = self.values[at]
                return value >> 16, (value & 0xFFFF) - 0x8000
            if len(self.states) > self.bound:
                # start afresh with the states that chunks are in (at most one a chunk)
                used, state[:] = np.unique(state, return_inverse=True)
                keep = [self.states[i] for i in used]
                self.reset(keep)
                state[:] = np.array([self.number[s] for s in keep], dtype=np.int64)[state]
                continue
            self._insert(np.unique(key[missing]))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of every text."""
        lead = S.SPACE if self.dummy_prefix else ""
        raw = [(lead + t.replace(" ", S.SPACE)).encode("utf-32-le", "replace") if t else b"" for t in texts]
        sep = (0x110000).to_bytes(4, "little")
        points = np.frombuffer(sep.join(raw) + sep, dtype=np.uint32)
        sym = self.symbol[points]
        ends = np.cumsum([len(r) // 4 + 1 for r in raw]) if raw else np.empty(0, dtype=np.int64)
        emitted = self.run(sym)
        total = np.concatenate([[0], np.cumsum(emitted)])
        return total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else ends

    def run(self, sym: np.ndarray) -> np.ndarray:
        """Emitted counts at every position of a symbol sequence that starts in the start state."""
        n = len(sym)
        lanes = max(1, -(-n // CHUNK))
        grid = np.zeros(lanes * CHUNK, dtype=np.int64)
        grid[:n] = sym
        before = np.concatenate([[RESET], grid[:-1]])
        sync = (before < 5) | self.starts[grid] & (before != grid)
        first = sync.reshape(lanes, CHUNK)
        known = first.any(axis=1)
        head = np.where(known, first.argmax(axis=1), CHUNK)  # characters before the first place that starts anew
        by_time = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
        out = np.zeros((CHUNK, lanes), dtype=np.int16)
        # the constant part of every chunk's map
        state = np.zeros(lanes, dtype=np.int64)
        tail = np.where(np.arange(CHUNK)[:, None] < head, RESET, by_time)
        for t in range(int(head.min(initial=CHUNK)), CHUNK):
            state, out[t] = self.advance(state, tail[t])
        final = [self.states[s] for s in state]  # by content: numbers may change below
        # prefix scan: a chunk with a constant part passes its own state on; one without passes on what its entry leads to
        turn = np.arange(lanes) - np.maximum.accumulate(np.where(known, np.arange(lanes), -1))
        turn = np.concatenate([[1], turn[:-1] + 1])  # chunks whose entry is settled by the same number of compositions
        for k in range(1, int(turn.max(initial=0)) + 1):
            now = np.flatnonzero((turn == k) & (head > 0))
            now = now[np.argsort(-head[now], kind="stable")]
            state = np.array([self._number(final[i - 1]) if i else 0 for i in now], dtype=np.int64)
            length = head[now]
            for t in range(int(length.max(initial=0))):
                m = int(np.searchsorted(-length, -t, side="left"))  # chunks with more than t characters of head
                state, out[t, now[:m]] = self.advance(state[:m].copy(), by_time[t, now[:m]])
                for i in np.flatnonzero(length[:m] == t + 1):
                    if not known[now[i]]:
                        final[now[i]] = self.states[state[i]]
        return out.T.reshape(-1)[:n]


_compiled: dict[int, Transducer] = {}


def _transducer(data: bytes) -> Transducer:
    """One transducer a worker process, kept between tasks."""
    key = hash(data)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(data)
    return _compiled[key]


def token_counts(docs: DataFrame, model: bytes, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``model`` is the content of a SentencePiece BPE model file; counts are those
    of the library without added special tokens.  A NULL text counts as empty
    (0 bytes, 0 tokens).  Rows are independent, so repeated rows and ids stay; texts of any length
    are read whole; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(model)
        for b in batches:
            for piece in slices(b):
                n = fst.counts([t or "" for t in piece.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), pa.array(n.astype(np.int64)), pa.array(n > limit)],
                                                 ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
