import hashlib
from collections import Counter

import numpy as np
import pytest

from docket.llm.suffix_dedup import common_prefixes, dedup_substrings, gram_hashes, repeats, suffix_array, window_minima


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((d, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows, length, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, th string, shard int").repartition(5)
    return sorted(((r["doc_id"], r["n_bytes"], [(s["s"], s["e"]) for s in r["spans"]], bytes(r["kept"]))
                   for r in dedup_substrings(df, length, **kw).collect()), key=str)


def corpus(rng, n, passages, size):
    words = ["alpha", "beta", "gämma", "delta", "epsilon", "zeta", "η", "theta", "iota"]

    def prose(k):
        return " ".join(words[i] for i in rng.integers(0, len(words), k))

    shared = [prose(size) for _ in range(passages)]
    rows = []
    for i in range(n):
        parts = [prose(int(rng.integers(0, size)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [shared[int(rng.integers(0, passages))][int(rng.integers(0, 30)):], prose(int(rng.integers(1, size)))]
        rows.append((i, " ".join(parts)))
    return rows


ODD = [(900, None), (901, ""), (None, "short"), (None, "short"), (902, "ab" * 700), (903, "ab" * 650), (904, "a" * 900), (905, "日本語" * 200)]


@pytest.mark.parametrize("shard_bytes, merge_rows", [(1 << 20, 400_000), (3000, 500), (1, 100)])
def test_against_brute_force(spark, shard_bytes, merge_rows):
    rng = np.random.default_rng(5)
    rows = corpus(rng, 60, 6, 90)
    rows += [(100 + i, rows[i][1]) for i in range(4)] + rows[:2]  # exact copies and repeated rows
    rows += [(200 + i, rows[3][1][:i * 40] + "X" + rows[3][1][i * 40:]) for i in range(12)] + ODD  # near copies
    assert run(spark, rows, 400, shard_bytes=shard_bytes, merge_rows=merge_rows) == brute(rows, 400)


@pytest.mark.parametrize("length", [1, 2, 9, 30])
def test_short_windows(spark, length):
    rng = np.random.default_rng(length)
    rows = [(i, "".join(rng.choice(list("abcdef" if length > 5 else "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"), int(rng.integers(0, 60))))) for i in range(40)]
    rows += [(50, "xyzzy " * 9), (51, rows[7][1])]
    assert run(spark, rows, length, shard_bytes=200, merge_rows=50) == brute(rows, length)


def test_common_passage_and_long_text(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghij klmnop"))
    common = "".join(rng.choice(letters, 450))
    rows = [(i, "".join(rng.choice(letters, 300)) + common + "".join(rng.choice(letters, 200))) for i in range(150)]
    plain = brute(rows, 400)
    long = "".join(rng.choice(letters, 1_300_000))  # more than a block, repeats across the block border
    rows += [(500, long), (501, "!" + long[1_048_000:1_049_800] + "?")]
    got = {r[0]: r for r in run(spark, rows, 400, shard_bytes=20_000, merge_rows=2000)}
    assert sorted((got[i] for i in range(150)), key=str) == plain
    assert got[500][2] == [(1_048_000, 1_049_800)] and got[501][2] == [(1, 1801)] and got[501][3] == b"!?"
    assert hashlib.sha256(got[500][3]).digest() == hashlib.sha256((long[:1_048_000] + long[1_049_800:]).encode()).digest()


def test_empty_table_and_arguments(spark):
    assert run(spark, [], 400) == []
    with pytest.raises(ValueError):
        run(spark, [], 0)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(9)
    for text in [rng.integers(0, 3, 400), np.zeros(60, np.int64), np.tile([1, 2, 256, 0], 40), rng.integers(0, 257, 500)]:
        t = text.astype(np.int64)
        sa, rank = suffix_array(t)
        plain = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa.tolist() == plain and (rank[sa] == np.arange(len(t))).all()
        shared = common_prefixes(t, sa, rank, np.array([0]), np.array([len(t)]), 10**6 if len(t) < 100 else 50)
        limit = 10**6 if len(t) < 100 else 50
        for a, b in zip(sa[:-1], sa[1:]):
            n = 0
            while b + n < len(t) and a + n < len(t) and t[a + n] == t[b + n] and n < limit:
                n += 1
            assert shared[b] == n


def test_windows_of_contexts():
    bodies = [b"abcdefgh", b"xabcdeq", b"abcd", b"", b"zzzzzzz"]
    context, place, again, kind = repeats(bodies, 5)
    got = [(int(c), int(p)) for c, p, a in zip(context, place, again) if a]
    assert got == [(0, 0), (1, 1), (4, 0), (4, 1), (4, 2)] and len(set(kind.tolist())) == len({bodies[c][p:p + 5] for c, p in zip(context, place)})


def test_hashes_and_minima():
    rng = np.random.default_rng(10)
    body = rng.integers(0, 4, 300).astype(np.uint8)
    for gram in (1, 2, 3, 7, 128):
        h = gram_hashes(body, gram)
        assert len(h) == 300 - gram + 1
        seen = {}
        assert all(seen.setdefault(body[i:i + gram].tobytes(), x) == x for i, x in enumerate(h)) and len(set(seen.values())) == len(seen)
    v = rng.integers(0, 99, 100).astype(np.uint64)
    assert all((window_minima(v, w) == [v[i:i + w].min() for i in range(100 - w + 1)]).all() for w in (1, 2, 7, 99, 100))
