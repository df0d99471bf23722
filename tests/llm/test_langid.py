import numpy as np

from docket.llm import langid as L
from docket.llm.common import crc_mod
from docket.session import read_table

DIR = "/root/testdata/sf0.01"


def test_gradients_match_finite_differences():
    net = L.fresh(["a", "b", "c"], hidden=3, dtype=np.float64)
    x, lengths = L.pad([b"abca", b"b", b"cab"])
    y, w = np.array([0, 1, 2]), np.array([1.0, 2.0, 0.5])
    loss, grads = net.gradients(x, lengths, y, w)
    rng = np.random.default_rng(0)
    for p, g in zip(net.params(), grads, strict=True):
        for _ in range(12):
            i = tuple(rng.integers(0, n) for n in p.shape) if p.shape != net.table.shape else (rng.integers(2), rng.choice([97, 98, 99]), rng.integers(9))
            old = p[i]
            p[i] = old + 1e-5
            up = net.gradients(x, lengths, y, w)[0]
            p[i] = old - 1e-5
            down = net.gradients(x, lengths, y, w)[0]
            p[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_pooling_equals_direct_evaluation():
    net = L.fresh(["a", "b"])
    texts = ["One two two", None, "", "42 !!", "x" * 70 + " y", "two"]
    got = L.Labeller(net).documents(texts)
    for t, row in zip(texts, got, strict=True):
        want = np.zeros(3)
        for w in (t or "").lower().split():
            if L.has_letter(w):
                for p in L.pieces(w):
                    x, n = L.pad([p])
                    want += [*net.positions(x, n)[0][:, 0].sum(axis=0), len(p)]
        assert np.allclose(row, want, atol=1e-4)


def test_many_words_in_one_text(monkeypatch):
    monkeypatch.setattr(L, "WORDS_KEPT", 7)
    net = L.fresh(["a", "b"])
    text = " ".join(f"w{i % 40}" for i in range(100))
    small = L.Labeller(net).documents([text, "w1 w2", "w1"])
    monkeypatch.setattr(L, "WORDS_KEPT", 1000)
    assert np.allclose(small, L.Labeller(net).documents([text, "w1 w2", "w1"]), atol=1e-3)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = read_table(spark, DIR, "documents")
    net = L.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    rows = L.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter(crc_mod("doc_id", 4) == 2).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows)
    assert right >= 0.97, right
    assert all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "12 34 --", "n"), (4, "the " * 100_000, "n"), (4, "the", "n"), (None, "the", "n")],
                                "doc_id bigint, text string, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"]) for r in L.predict(odd, net).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "en")], key=str)
    assert L.predict(odd.limit(0), net).count() == 0
    assert L.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in L.predict(odd, None).collect()} == {"und"}
