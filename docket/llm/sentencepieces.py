"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model protobuf is parsed here; normaliser, white-space marker, merges or
unigram scores and byte fallback are rebuilt as a ``tokenizers`` pipeline, which
encodes and decodes batches on several threads inside each task.  ``verify`` holds its ids
against the sentencepiece library for every text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm import spm_model as S
from docket.llm.common import id_and_text, slices, tidy

THREADS = 2
WORDS_KEPT = 500_000  # words a task remembers at once
WORDS_AT_ONCE = 8_192  # words handed to the libraries together: their results are some hundred times as large as the ids
DECODED_AT_ONCE = 64  # texts whose ids are lists at a time
HIDDEN = "\U0010fffe"  # noncharacter: keeps control pieces from matching text


def merges(model: S.SpmModel) -> list[tuple[str, str]]:
    """All splits of the normal pieces into two known parts, by descending score, shorter left parts first."""
    score = {p: s for p, s, t in model.pieces if t == S.NORMAL}
    order = sorted(score, key=lambda p: -score[p])  # stable: equal scores keep the order of the ids
    return [(p[:i], p[i:]) for p in order for i in range(1, len(p)) if p[:i] in score and p[i:] in score]


def build(data: bytes):
    """Model file content -> ``tokenizers.Tokenizer`` without added special tokens."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = S.parse(data)
    names = [HIDDEN + p if t in (S.CONTROL, S.UNUSED) else p for p, _, t in m.pieces]
    if m.model_type == S.BPE:
        vocab = {p: i for i, p in enumerate(names)}
        tok = Tokenizer(models.BPE(vocab, merges(m), unk_token=names[m.unk_id], fuse_unk=not m.byte_fallback, byte_fallback=m.byte_fallback))
    else:
        low = min((s for _, s, t in m.pieces if t == S.NORMAL), default=0.0) - 1000  # never preferred to a match
        scores = [(p, s if t == S.NORMAL else low) for p, (_, s, t) in zip(names, m.pieces, strict=True)]
        tok = Tokenizer(models.Unigram(scores, unk_id=m.unk_id, byte_fallback=m.byte_fallback))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(S.SPACE))
    steps.append(normalizers.Replace(" ", S.SPACE))
    tok.normalizer = normalizers.Sequence(steps)
    if not any(b == S.SPACE and a != S.SPACE for p, _, _ in m.pieces for a, b in zip(p, p[1:], strict=False)):
        # no piece reaches from a word into the next marker, so words can be encoded (and remembered) one by one
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{S.SPACE}+[^{S.SPACE}]*"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace(S.SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tok


class Encoder:
    """Batch encoder that remembers pieces of text.

    Where no vocabulary piece reaches from a word into the next marker or over a line break, and
    the normaliser only places markers, every word (with the spaces before it) and every line break is encoded on its own:
    equal words of a task are encoded once, and the ids of a text are put
    together from them.  Other models encode whole texts.
    """

    def __init__(self, data: bytes, threads: int = THREADS, kept: int | None = None):
        self.tokenizer, self.data, self.threads, self.kept = build(data), data, threads, kept or WORDS_KEPT
        m = S.parse(data)
        plain = not m.charsmap and not m.remove_extra_whitespaces and m.add_dummy_prefix
        whole = all(a == S.SPACE or b != S.SPACE for p, _, _ in m.pieces for a, b in zip(p, p[1:], strict=False))
        breaks = not any("\n" in p for p, _, t in m.pieces if t == S.NORMAL)
        self.by_word = plain and whole and breaks and m.byte_fallback
        if self.by_word:  # the one tokenizer then encodes words and decodes texts
            from tokenizers import normalizers

            self.tokenizer.normalizer = normalizers.Replace(" ", S.SPACE)  # the leading marker comes with the words
            gap = " " + S.SPACE  # a marker in the text itself counts as a space
            self.cut = re.compile(f"[{gap}]+[^{gap}\n]*|\n|[^{gap}\n]+")
            self.reset()

    def reset(self):
        """Forget all words."""
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.same = np.empty(0, dtype=bool)  # whether the library gives a word the same ids
        self.uses = np.empty(0, dtype=np.int64)  # how often a word was met since the last clean-up

    def forget(self):
        """Keep the words that were met more than once, if they are at most half of what may be kept; else start afresh."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.kept // 2:
            self.reset()
            return
        wanted = set(keep.tolist())
        words = [w for i, w in enumerate(self.index) if i in wanted]  # in the order of their numbers
        n = self.sizes[keep]
        starts = np.cumsum(n) - n
        self.flat = self.flat[np.repeat(self.starts[keep] - starts, n) + np.arange(n.sum())]
        self.starts, self.sizes, self.same, self.uses = starts, n, self.same[keep], np.zeros(len(keep), dtype=np.int64)
        self.index = dict(zip(words, range(len(words)), strict=True))

    @cached_property
    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    def learn(self, words: list[str], verify: bool):
        for at in range(0, len(words), WORDS_AT_ONCE):
            self._learn(words[at:at + WORDS_AT_ONCE], verify)

    def _learn(self, words: list[str], verify: bool):
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))])
        self.same = np.concatenate([self.same, self.agrees(words, ids) if verify else np.zeros(len(words), dtype=bool)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), dtype=np.int64)])

    def agrees(self, words: list[str], ids: list[list[int]]) -> np.ndarray:
        """Compare with the library, which puts a marker before a text: here before a line break, whose two ids are left out."""
        want = self.library.encode(["\n" + w for w in words], num_threads=self.threads)
        return np.fromiter((x == y[2:] for x, y in zip(ids, want, strict=True)), dtype=bool, count=len(words))

    def encode(self, texts: list[str], verify: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of every text and, if asked for, whether the sentencepiece library gives the same."""
        if not self.by_word:
            ids = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            want = self.library.encode(texts, num_threads=self.threads) if verify else ids
            return ids, np.array([x.tolist() == list(y) for x, y in zip(ids, want, strict=True)], dtype=bool)
        cut = [self.cut.findall(" " + t) if t else [] for t in texts]
        new = list({w for c in cut for w in c if w not in self.index})
        if len(self.index) + len(new) > self.kept:
            self.forget()
            new = list({w for c in cut for w in c if w not in self.index})
        if new:
            self.learn(new, verify)
        size = [len(c) for c in cut]
        at = np.fromiter((self.index[w] for c in cut for w in c), dtype=np.int64, count=sum(size))
        self.uses += np.bincount(at, minlength=len(self.uses))
        n = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.starts[at] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else self.flat[:0]
        bounds = ends[np.concatenate([[0], np.cumsum(size)]).astype(np.int64)]
        wrong = np.concatenate([[0], np.cumsum(~self.same[at])])[np.concatenate([[0], np.cumsum(size)]).astype(np.int64)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.diff(wrong) == 0


_built: dict[bytes, Encoder] = {}


def _backend(data: bytes, threads: int, verify: bool = False, kept: int | None = None) -> Encoder:
    """One encoder a worker process, kept (without its words) between tasks; thread count is set before the library starts its pool."""
    key = hashlib.sha256(data).digest() + f"{verify} {kept}".encode()
    if key not in _built:
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        _built.clear()
        _built[key] = Encoder(data, threads, kept)
    return _built[key]


def _id_column(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """``doc_id, ids array<int>`` for every row; a NULL text gives NULL ids, an empty text no ids.

    ``model`` is the content of a SentencePiece model file (unigram or BPE).
    Rows are independent: repeated rows and ids stay as they are; whole texts of any length are
    encoded; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _backend(model, threads)
        for b in batches:
            for piece in slices(b):
                texts = piece.column("text").to_pylist()
                ids = _id_column(encoder.encode([t or "" for t in texts])[0])
                null = pa.array([t is None for t in texts])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pc.if_else(null, pa.scalar(None, ids.type), ids)], ["doc_id", "ids"])
        encoder.reset()

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids", threads: int = THREADS) -> DataFrame:
    """``doc_id, text`` from ids; NULL ids give a NULL text, no ids the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _backend(model, threads).tokenizer
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = part.column("ids").to_pylist()
                texts = tok.decode_batch([x or [] for x in ids], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())],
                                                 ["doc_id", "text"])

    rows = encoded.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, text string")


def verify(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS,
           with_ids: bool = False, kept: int | None = None) -> DataFrame:
    """Encode, decode and compare every row with the sentencepiece library, in one pass over the text.

    ``doc_id, n_tokens, ids_sha256`` (of the ids as little-endian 32-bit integers),
    ``decoded_sha256`` (of the decoded text in UTF-8), ``round_trip`` (decoded
    text equals the text) and ``parity`` (the library gives the same ids; where words are encoded
    one by one, every distinct word is held against it, as no piece reaches across);
    ``with_ids`` adds ``ids array<int>``; ``kept`` bounds the words a task remembers (speed only).
    A NULL text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _backend(model, threads, verify=True, kept=kept)
        for b in batches:
            for piece in slices(b):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                found, same = encoder.encode(texts, verify=True)
                back = []
                for at in range(0, len(found), DECODED_AT_ONCE):
                    back += encoder.tokenizer.decode_batch([x.tolist() for x in found[at:at + DECODED_AT_ONCE]], skip_special_tokens=False)
                extra = [_id_column(found)] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(x) for x in found], pa.int64()),
                     pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found]),
                     pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back]),
                     pa.array([a == t for a, t in zip(back, texts, strict=True)]), pa.array(same), *extra],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "parity", *["ids"] * with_ids])
        encoder.reset()  # a worker that goes on with other work keeps no words

    return id_and_text(docs, id_col, text_col).mapInArrow(
        tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean" + ", ids array<int>" * with_ids)
