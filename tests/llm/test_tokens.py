import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from docket.llm import sentencepieces as E
from docket.llm import spm_model as S
from docket.llm import token_automaton as A
from docket.session import read_table

DIR = "/root/testdata/sf0.01"
MODEL = open(P.path("piece_bpe_32k.model"), "rb").read()
ODD = ["", " ", "  ", "\n", "a", "▁", "▁▁ a", "x▁y", "<s> </s> <unk>", "<0x0A>", "tab\tand\nline", "    four     five      six       seven",
       "日本語のテキスト", "🙂🙃 emoji", "\x00 null", "Ünïcödé é", "a" * 3000, " " * 700, "ab" * 1500, "0123456789" * 300,
       "the " * 600, "﷽​ x", "\U0010ffff", "e" * 511 + " " + "f" * 513, "vector" * 400 + " end"]


def noise(n, seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop     \n\t.,;:-_ABCÜé日本🙂▁<>0x1"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@pytest.fixture(scope="module")
def prose():
    import pyarrow.parquet as pq

    return pq.read_table(f"{DIR}/documents.parquet").column("text").to_pylist()[:300]


def test_transducer_counts_equal_the_library(library, prose):
    fst = A.Transducer(MODEL)
    for texts in (ODD, noise(400, 1), prose):
        want = [len(x) for x in library.encode(texts)]
        assert fst.counts(texts).tolist() == want


def test_transducer_with_few_states_and_short_chunks(library, monkeypatch):
    monkeypatch.setattr(A, "MAX_STATES", 40)
    monkeypatch.setattr(A, "CHUNK", 7)
    texts = ODD + noise(100, 2)
    assert A.Transducer(MODEL).counts(texts).tolist() == [len(x) for x in library.encode(texts)]


def test_counts_query(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, None, "x"), (None, "the the", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, A.token_counts(df, MODEL, limit=100).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert A.token_counts(df.limit(0), MODEL).count() == 0


def test_encode_decode_parity(spark, library, prose):
    texts = ODD + noise(200, 3) + prose
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(-1, None, 1)], "doc_id bigint, text string, ids int")
    ids = {r["doc_id"]: r["ids"] for r in E.encode(df, MODEL).collect()}
    assert ids[-1] is None and all(ids[i] == library.encode(t) for i, t in enumerate(texts))
    back = {r["doc_id"]: r["text"] for r in E.decode(E.encode(df, MODEL), MODEL).collect()}
    assert back[-1] is None and all(back[i] == library.decode(library.encode(t)) for i, t in enumerate(texts))
    rows = E.verify(df, MODEL).collect()
    assert len(rows) == len(texts) + 1 and all(r["parity"] for r in rows)
    for r in rows:
        t = texts[r["doc_id"]] if r["doc_id"] >= 0 else ""
        assert r["n_tokens"] == len(library.encode(t))
        assert r["ids_sha256"] == hashlib.sha256(np.array(library.encode(t), dtype="<i4").tobytes()).hexdigest()
        assert r["round_trip"] == (library.decode(library.encode(t)) == t)
    assert all(r["round_trip"] for r in rows if r["doc_id"] >= len(ODD) + 200)
    assert E.verify(df.limit(0), MODEL).count() == 0


def test_encoder_forgets_rare_words(library, prose, monkeypatch):
    monkeypatch.setattr(E, "WORDS_KEPT", 3000)
    enc = E.Encoder(MODEL)
    for k in range(0, 200, 5):
        texts = prose[k:k + 5] + ODD[k % len(ODD):k % len(ODD) + 2]
        found, same = enc.encode(texts, verify=True)
        assert [x.tolist() for x in found] == library.encode(texts) and same.all()
    assert len(enc.index) <= 6000


def _field(number, payload):
    if isinstance(payload, bytes):
        size, out = len(payload), b""
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return bytes([number << 3 | 2]) + out + bytes([size]) + payload
    if isinstance(payload, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", payload)
    key = number << 3
    head = bytes([key]) if key < 128 else bytes([key & 127 | 128, key >> 7])
    return head + bytes([payload])


def unigram_model():
    """A hand-written unigram model: letters, a few words, byte pieces."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = ["▁", "▁the", "▁th", "e", "▁a", "t", "h", "he", "an", "n", "d", "and", "▁and", "in", "i", "g", "ing", "▁in", "s", "r", "er", "a", "o", "on", "ion", "tion"]
    pieces += [(w, -2.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, t)) for p, s, t in pieces)
    trainer = _field(3, 1) + _field(35, 1)
    return body + _field(2, trainer) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))


def test_unigram_parity():
    data = unigram_model()
    m = S.parse(data)
    assert m.model_type == S.UNIGRAM and m.byte_fallback and len(m.pieces) == 285
    library, tok = sentencepiece.SentencePieceProcessor(model_proto=data), E.build(data)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("thean dingsro  é") for _ in range(rng.randrange(1, 60)))
        assert tok.encode(text, add_special_tokens=False).ids == library.encode(text)
        assert tok.decode(library.encode(text), skip_special_tokens=False) == library.decode(library.encode(text))


def test_words_reach_the_libraries_in_bounded_batches(monkeypatch):
    from docket.llm.queries import piece_model

    class Spy:
        def __init__(self, inner):
            self.inner, self.sizes = inner, []

        def __getattr__(self, name):
            def call(rows, *a, **k):
                self.sizes.append(len(rows))
                return getattr(self.inner, name)(rows, *a, **k)

            return call

    texts = [" ".join(f"word{i * j} café{j}" for j in range(30)) for i in range(40)]
    want, agrees = E.Encoder(piece_model()).encode(texts, verify=True)
    monkeypatch.setattr(E, "WORDS_AT_ONCE", 50)
    coder = E.Encoder(piece_model())
    coder.tokenizer, coder.library = Spy(coder.tokenizer), Spy(coder.library)
    got, same = coder.encode(texts, verify=True)
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and (same == agrees).all() and same.all()
    assert len(coder.index) > 400
    for seen in (coder.tokenizer.sizes, coder.library.sizes):
        assert max(seen) <= 50 and sum(seen) == len(coder.index)
