import hashlib
from collections import defaultdict

from docket.llm.exact_dedup import exact_dedup


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, keep(g), len(g), i == keep(g), hashlib.sha256(t.encode()).hexdigest())
                  for t, g in groups.items() for i in g)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, sha string")
    return sorted(map(tuple, exact_dedup(df, **kw).collect()))


def test_groups_nulls_long_and_split_runs(spark):
    long = "wort " * 60_000
    rows = [(i, ["a", "b", "", None, long, "a "][i % 6]) for i in range(60)]
    rows += [(100 + i, "hot") for i in range(400)] + [(1000, "x" * 80 + "1"), (1001, "x" * 80 + "2")]
    for keep, f in (("max", max), ("min", min)):
        assert run(spark, rows, keep=keep) == brute(rows, f)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, "same" if i % 3 else f"t{i}") for i in range(50)]
        assert run(spark, rows, keep="max") == brute(rows, max)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_ids(spark):
    rows = [(None, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (None, "own"), (None, None), (3, ""), (4, "c")]
    sha = {t: hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    best = {"min": {"a": 1, "": 3, "c": 4}, "max": {"a": 2, "": 3, "c": 4}}
    size = {"a": 3, "b": 2, "own": 1, "": 2, "c": 1}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for keep in ("min", "max"):
        want = [(i, best[keep].get(t or ""), size[t or ""], None if i is None else i == best[keep][t or ""], sha[t]) for i, t in rows]
        assert sorted(map(tuple, exact_dedup(df, keep=keep).collect()), key=str) == sorted(want, key=str)


def test_runs_over_many_ranges(spark):
    """Runs that begin, end, fill or skip ranges, with small batches and as many ranges as there are partitions."""
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for rows in ([(i, "hot") for i in range(300)],
                     [(i, "hot" if i % 4 else f"t{i % 40}") for i in range(300)],
                     [(i, f"{i % 11}" * (i % 3)) for i in range(200)],
                     [(i, f"u{i}") for i in range(40)] + [(99, "u7"), (98, "u39"), (97, "u0")]):
            for keep, f in (("max", max), ("min", min)):
                assert run(spark, rows, keep=keep) == brute(rows, f)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_neighbour_comparison_decides():
    """The scan alone forms the groups: texts with equal digests but different content stay apart, equal ones meet."""
    import numpy as np
    import pyarrow as pa
    import pytest

    from docket.llm import exact_dedup as E

    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3, 4], pa.int64()), "text": ["a", "a", "b", "b"], "sha": ["s"] * 4})
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(E.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
        out = pa.Table.from_batches(list(E._neighbours("max")(iter([rows.slice(0, 3), rows.slice(3)])))).to_pandas()
    assert out[out["size"].isna()]["run"].tolist() == [0, 0, 1, 1]
    assert [tuple(r) for r in out[out["size"].notna()][["run", "size", "best", "edge"]].to_numpy().astype(np.int64)] == [(0, 2, 2, 1), (1, 2, 4, 2)]
