import random

import numpy as np
import pytest

from docket.llm import line_dedup as L
from docket.llm.hashing import RangeHash


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows, min_words=5):
    """(id, text) rows -> cleaned texts, by comparing every line with every earlier one."""
    docs = sorted({(i is not None, i or 0, t): (i, t) for i, t in rows if t is not None}.values(), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, {}
    first = {}
    for i, t in docs:
        for n, line in enumerate(t.split("\n")):
            w = tuple(line.encode().split())
            if w:
                first.setdefault(w, (i, t, n))
    order = [w for w in first if len(w) >= min_words]
    near = {w for k, w in enumerate(order) if any(abs(len(o) - len(w)) < 2 and edit_distance(o, w) <= 1 for o in order[:k])}
    for i, t in docs:
        keep = []
        for n, line in enumerate(t.split("\n")):
            w = tuple(line.encode().split())
            if not w or (first[w] == (i, t, n) and w not in near):
                keep.append(line)
        out[i, t] = "\n".join(keep)
    del seen
    return sorted(((i, t, None if t is None else out[i, t]) for i, t in rows), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id bigint, text string, clean_text string, line int")
    return sorted(((r["row"]["doc_id"], r["row"]["text"], r["clean_text"]) for r in L.dedup_lines(df, **kw).collect()), key=str)


def test_within_one_edit():
    rng = random.Random(0)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(5))] for _ in range(2))
        assert L.within_one_edit(a, b) == (edit_distance(a, b) <= 1)


def test_range_hash():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**64, 30, dtype=np.uint64)
    both = np.concatenate([w, w[:9], w[10:]])
    h, a = RangeHash(both), np.array
    assert h(a([0]), a([9]))[0] == h(a([30]), a([39]))[0] != h(a([1]), a([9]))[0]
    assert h.without(a([0]), a([9]), a([30]))[0] == h(a([30]), a([59]))[0]


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "b", "c", "dd", "e"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 8)))
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 4)))) for i in range(150)]
    base = [f"w{k}" for k in range(12)]
    rows += [(200 + i, " ".join(base[:i % 12] + [f"new{i}"] + base[i % 12 + (i % 2):])) for i in range(60)]  # one large near group
    rows += [(300 + i, "the very common line of all documents\nown line number " + str(i) + " with x" * (i % 5)) for i in range(40)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (None, "null id line with five words"), (403, "null id line with five words"),
             (404, "  tabs\tand   spaces count as one "), (405, "tabs and spaces count as one"), (404, "  tabs\tand   spaces count as one "),
             (406, "long " * 30_000), (407, "long " * 29_999)]
    assert run(spark, rows) == brute(rows)


def test_limits(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "one two three four five"), (2, "one two three four six")], near=False)[1][2] == "one two three four six"
    with pytest.raises(ValueError):
        L.line_drops(spark.createDataFrame([], "doc_id bigint, text string"), min_words=1)


def test_short_repeats(spark):
    rows = [(1, "All rights reserved.\n\none two three four five"), (2, "All rights  reserved.\n\nAll rights\none two three four"), (3, "x\nx\n \n \none two three four six")]
    assert [c for _, _, c in run(spark, rows)] == ["All rights reserved.\n\none two three four five", "\nAll rights\none two three four", "x\n \n "]
    assert [c for _, _, c in run(spark, rows, short_repeats=False)] == [rows[0][1], rows[1][1], "x\nx\n \n "]
