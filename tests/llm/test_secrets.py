import re

import numpy as np

from docket.llm import secrets as S
from docket.session import read_table

DIR = "/root/testdata/sf0.01"


def plain(text):
    """Base spans straight from the definition."""
    out = []
    a = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""
    for k, pattern, least in ((0, a, 6), (1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text):
            if len(m.group(2) if k == 0 else m.group()) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = ["", "password=abcdef", "PassWord : 'abc'", "x token=password=abcdefg", "api_key=12345 apikey: \"123456\"", "AKIA" + "A" * 16, "AKIA" + "A" * 15,
         "a" * 24, "0" * 23 + "g" + "0" * 30, "ſecret=abcdefgh Kapi", "日本 token = zzzzzzzz 日本 " + "ab12" * 10, "secret=" + "x" * 100_000,
         "to" + "ken=abcdef" * 3, "AKIAAKIA" + "B" * 20, "0123456789abcdef" * 3 + " 0123456789ABCDEF0123456789"]


def test_base_spans():
    for t in TEXTS:
        assert S.base_spans(t) == plain(t), t


def test_gradients_match_finite_differences():
    net = S.fresh()
    x, y, w = S.codes([S.window("abc 12345 xyz", 4, 9), S.window("key=abcdefgh", 4, 12), S.window("z" * 90, 10, 80)]), np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, grads = net.gradients(x, y, w)
    rng = np.random.default_rng(1)
    for p, g in zip(net.params, grads, strict=True):
        for j in np.concatenate([np.argsort(-np.abs(g).ravel())[:4], rng.integers(0, p.size, 4)]):
            i = np.unravel_index(j, p.shape)
            old = p[i]
            p[i] = old + 1e-6
            up = net.gradients(x, y, w)[0]
            p[i] = old - 1e-6
            down = net.gradients(x, y, w)[0]
            p[i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_threshold_and_calibration():
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.3).astype(float)
    logit = 3 * (rng.normal(size=4000) + 2 * y - 1)
    a, b = S.calibrate(logit, y)
    p = 1 / (1 + np.exp(-(a * logit + b)))
    for low, high in ((0.1, 0.3), (0.4, 0.6), (0.7, 0.9)):
        inside = (p > low) & (p < high)
        assert abs(y[inside].mean() - p[inside].mean()) < 0.12
    assert S.recall_threshold(np.array([0.9, 0.8, 0.7, 0.6, 0.2]), np.array([1, 1, 1, 1, 1]), 0.8) == 0.6
    assert S.recall_threshold(np.array([0.3]), np.array([1])) == 0.5


def test_network_finds_what_the_rules_miss(spark):
    docs = read_table(spark, DIR, "documents")
    net = S.fit(docs)
    assert 0.5 <= net.threshold <= 1
    rows = {r["doc_id"]: r for r in S.digest(S.scan(docs, net)).collect()}
    for r in docs.collect():
        base = plain(r["text"])
        got = rows[r["doc_id"]]
        assert [got["n_assign"], got["n_access"], got["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert got["base_sha256"] == S.text_digest(base)
        kept = [s for s in got["spans"].split(",") if s and not s.startswith("net")]
        assert kept == [f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base]
        spans = [s.split(":") for s in got["spans"].split(",") if s]
        assert spans == sorted(spans, key=lambda s: (int(s[1]), S.KINDS.index(s[0])))


def test_held_out_recall():
    """Findings with hidden context, made of random strings, are told from numbers and words."""
    rng = np.random.default_rng(5)
    hexes = ["the " + "".join(rng.choice(list("0123456789abcdef"), 24)) + " and" for _ in range(400)]
    plainer = ["the " + "".join(rng.choice(list("0123456789"), 16)) + " and" for _ in range(400)]
    windows = [S.window(t, 4, len(t) - 4) for t in hexes + plainer]
    y = np.array([1] * 400 + [0] * 400)
    net = S.train(windows, y)
    p = net.probabilities(windows)
    assert (p[y == 1] >= net.threshold).mean() >= 0.93 and (p[y == 0] >= net.threshold).mean() <= 0.05


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, None, "x"), (None, TEXTS[1], "x")], "doc_id bigint, text string, spans string")
    rows = sorted(((r["doc_id"], r["spans"]) for r in S.digest(S.scan(df, S.fresh())).collect()), key=str)
    want = sorted([(i, ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in plain(t or ""))) for i, t in [*enumerate(TEXTS), (1, None), (None, TEXTS[1])]], key=str)
    assert rows == want
    assert S.scan(df.limit(0), S.fresh()).count() == 0
    assert S.fit(df.limit(0)).threshold == 2.0


def test_candidates_without_digits_and_keys_inside_long_runs(spark):
    assert S.candidates("the AbcDefGhiJklMnoPqr end") == [(4, 22)]
    assert S.cuts(3, 43) == [(3, 43)] and S.cuts(0, 100) == [(0, 40), (20, 60), (40, 80), (60, 100)] and S.cuts(0, 41) == [(0, 40), (1, 41)]
    assert len(S.cuts(0, 100_000)) < 5_001
    rng = np.random.default_rng(6)
    mixed = list("ABCDEFGHabcdefgh0123")
    keys = ["".join(rng.choice(mixed, 40)) for _ in range(400)]
    net = S.train([S.window(k, 0, 40) for k in keys] + [S.window("/" + "/".join(rng.choice(["usr", "lib", "share", "home"], 12)), 0, 40) for _ in range(400)],
                  np.array([1.0] * 400 + [0.0] * 400))
    plain_path, with_key = "/usr/lib/share/home" * 6, "/usr/lib/share/home" * 3 + keys[0] + keys[1] + "/usr/lib/share/home" * 3
    df = spark.createDataFrame([(1, f"x {plain_path} y"), (2, f"x {with_key} y")], "doc_id bigint, text string")
    found = {r["doc_id"]: [s for s in r["found"] if s["kind"] == "net"] for r in S.scan(df, net).collect()}
    assert found[1] == [] and [(s["start"], s["end"]) for s in found[2]] == [(2, 2 + len(with_key))]


def test_threshold_keeps_the_recall_below_one_half_and_with_hidden_context():
    p, y = np.array([0.9, 0.3, 0.2, 0.1]), np.array([1, 1, 1, 0])
    assert S.recall_threshold(p, y, 1.0, least=0.0) == 0.2
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh0123"), 20))
    # only the left context tells the classes apart
    windows = [S.window("my password = " + word(), 14, 34) for _ in range(300)] + [S.window("the other one " + word(), 14, 34) for _ in range(300)]
    y = np.array([1.0] * 300 + [0.0] * 300)
    net = S.train(windows, y, least=0.0)
    order = np.random.default_rng(11).permutation(len(y))
    held = [i for i in order[:len(y) // 4] if y[i] == 1]
    hidden = net.probabilities(["\0" * S.LEFT + windows[i][S.LEFT:] for i in held])
    assert (hidden >= net.threshold).mean() >= S.RECALL


def test_query_keeps_the_recall_without_a_floor(spark, monkeypatch):
    from docket.llm import queries as Q

    seen, train = [], S.train
    monkeypatch.setattr(S, "train", lambda *a, **kw: seen.append((kw, train(*a, **kw))) or seen[-1][1])
    assert Q.op9_secret_scan(spark, DIR).count() == read_table(spark, DIR, "documents").count()
    assert seen[0][0] == {"least": 0.0} and 0 < seen[0][1].threshold < 0.5
