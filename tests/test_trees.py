"""Histogram trees against plain ones that look at every row and every threshold."""
import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.operators import trees as T


def layout_of(cats, nums):
    levels = [sorted(set(c)) for c in cats]
    cuts = [sorted({float(x) for x in v if not np.isnan(x)}) for v in nums]
    return T.Layout([f"c{i}" for i in range(len(cats))], [f"n{i}" for i in range(len(nums))], levels, cuts, [True] * len(nums))


def data(seed, n=400):
    rng = np.random.default_rng(seed)
    cats = [rng.choice(list("abcde"), n), rng.choice(list("xyz"), n)]
    nums = [rng.integers(0, 9, n).astype(float), np.round(rng.normal(size=n), 1)]
    nums[1][rng.random(n) < 0.1] = np.nan
    y = ((cats[0] == "a") * 1.5 + nums[0] * 0.4 - np.nan_to_num(nums[1]) + rng.normal(size=n) > 2).astype(float)
    layout = layout_of(cats, nums)
    codes = np.stack([np.searchsorted(lv, c) for lv, c in zip(layout.levels, cats)]
                     + [np.where(np.isnan(v), len(cu), np.searchsorted(cu, np.nan_to_num(v))) for v, cu in zip(nums, layout.cuts)], axis=1).astype(np.int32)
    hot = [(cats[f] == lv).astype(float) for f in range(2) for lv in layout.levels[f]]
    cols = np.stack(hot + [np.where(np.isnan(v), np.nanmedian(v), v) for v in nums], axis=1)
    return layout, codes, cols, y


def plain_split(x, g, h, rows, min_leaf, l2):
    best = (0.0, None, None)
    score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
    for c in range(x.shape[1]):
        values = np.unique(x[rows, c])
        for a, b in zip(values[:-1], values[1:]):
            left, right = rows[x[rows, c] <= (a + b) / 2], rows[x[rows, c] > (a + b) / 2]
            if min(len(left), len(right)) < min_leaf or min(h[left].sum(), h[right].sum()) < T.MIN_HESSIAN:
                continue
            gain = score(left) + score(right) - score(rows)
            if gain > best[0] * (1 + 1e-10) + 1e-13:
                best = (gain, c, (a + b) / 2)
    return best


def plain_tree(x, g, h, rows, min_leaf=1, l2=0.0, max_leaves=None, max_depth=None):
    """Best-first tree: row -> (leaf value numerator, denominator), and the split gains in order."""
    out, gains, heap, leaves, n = np.zeros((len(x), 2)), [], [], 1, 0

    def push(r, depth):
        nonlocal n
        s = plain_split(x, g, h, r, min_leaf, l2) if max_depth is None or depth < max_depth else (0.0, None, None)
        out[r] = g[r].sum(), h[r].sum() + l2
        if s[0] > 0:
            heapq.heappush(heap, (-s[0], n, r, s, depth))
            n += 1

    push(rows, 0)
    while heap and (max_leaves is None or leaves < max_leaves):
        _, _, r, (gain, c, cut), depth = heapq.heappop(heap)
        gains.append(gain)
        leaves += 1
        push(r[x[r, c] <= cut], depth + 1)
        push(r[x[r, c] > cut], depth + 1)
    return out, gains


@pytest.mark.parametrize(("classes", "leaves", "depth", "l2"), [(True, 8, None, 0.0), (True, 31, 4, 1.0), (False, 6, 3, 0.1), (False, None, 3, 0.0)])
def test_boosting_equals_a_plain_booster(classes, leaves, depth, l2):
    layout, codes, cols, y = data(1)
    if not classes:
        y = y * 10 + cols[:, -2]
    params = {"max_iter": 12, "max_leaf_nodes": leaves, "max_depth": depth, "l2_regularization": l2, "min_samples_leaf": 7, "learning_rate": 0.2}
    spec = T.Spec(0, "gbt", classes, tuple(params.items()))
    fitted = T.fit_rows(layout, spec, range(12), codes, y, np.arange(len(y)))
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())) if classes else y.mean())
    assert np.isclose(fitted.base, score[0])
    for _, tree in fitted.trees:
        g, h = T.gradients(spec, y, score)
        stats, gains = plain_tree(cols, g, h, np.arange(len(y)), 7, l2, leaves, depth)
        score = score - 0.2 * stats[:, 0] / stats[:, 1]
        assert (tree.left < 0).sum() == len(gains) + 1
    assert np.allclose(T.predict(layout, fitted, codes), score, atol=1e-9)


@pytest.mark.parametrize("weight", [None, "balanced", "balanced_subsample"])
def test_forest_trees_equal_plain_trees(weight):
    layout, codes, cols, y = data(2)
    keys = np.arange(len(y)) * 7919
    spec = T.Spec(0, "rf", True, (("max_features", None), ("min_samples_leaf", 3), ("class_weight", weight), ("max_depth", None)))
    fitted = T.fit_rows(layout, spec, [0, 1, 4], codes, y, keys)
    for t, tree in fitted.trees:
        c = T.bootstrap(keys, spec.seed, t)
        base = np.ones(len(y)) if weight == "balanced" else c
        w = c * (1.0 if weight is None else np.where(y == 1, base.sum() / (2 * base[y == 1].sum()), base.sum() / (2 * base[y == 0].sum())))
        stats, _ = plain_tree(cols, w * y, w, np.flatnonzero(c > 0), 3)
        got = tree.value[tree.leaves(T.with_fill(codes, layout, fitted.fill), layout)]
        use = c > 0
        assert np.allclose(got[use], stats[use, 0] / stats[use, 1], atol=1e-9)


def test_column_draws_depth_and_split_limits():
    layout, codes, _, y = data(3)
    keys = np.arange(len(y))
    spec = T.Spec(0, "rf", True, (("max_features", "sqrt"), ("min_samples_split", 40), ("max_depth", 3)))
    trees = [t for _, t in T.fit_rows(layout, spec, range(30), codes, y, keys).trees]
    assert all(t.cover[t.left >= 0].min() >= 40 for t in trees)
    assert len({int(t.feature[0]) for t in trees}) > 2  # different columns win at the roots
    assert max(len(t.left) for t in trees) <= 15
    deep = T.fit_rows(layout, T.Spec(0, "rf", True, ()), [0], codes, y, keys).trees[0][1]
    assert len(deep.left) > 60  # no depth limit: grown until the leaves are pure
    assert set(np.round(deep.value[deep.left < 0], 12)) <= {0.0, 1.0} or np.isin(deep.value[deep.left < 0], [0.0, 1.0]).mean() > 0.9


def test_poisson_draws():
    c = T.bootstrap(np.arange(200_000), 42, 3)
    assert abs(c.mean() - 1) < 0.01 and abs(c.var() - 1) < 0.02 and (c == T.bootstrap(np.arange(200_000), 42, 3)).all()
    assert abs(np.corrcoef(c, T.bootstrap(np.arange(200_000), 42, 4))[0, 1]) < 0.01


def test_table_and_tasks_give_the_same_models(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i}", i, float(rng.integers(0, 2)), str(rng.choice(["a", "b", "c"])) if i % 9 else None, float(rng.integers(0, 40)) if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "external_id string, row_index bigint, label double, c string, n double").repartition(4)
    layout = T.fit_layout(df, ["c"], ["n"])
    specs = [T.Spec(0, "gbt", True, (("max_iter", 5), ("min_samples_leaf", 5), ("max_leaf_nodes", 6))), T.Spec(1, "gbt", False, (("max_iter", 4),), 150),
             T.Spec(2, "rf", True, (("n_estimators", 25), ("class_weight", "balanced_subsample")), 200)]
    local, spread = T.fit_models(df, layout, specs), None
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(T, "STATE_EVERY", 2)
        spread = T.fit_models(df, layout, specs, local_bytes=0)
    assert len(local) == len(spread) == 4  # the forest comes in two blocks
    for m in range(3):
        a, b = T.Ensemble.of(layout, local, m), T.Ensemble.of(layout, spread, m)
        x, y = ({r["external_id"]: r["p"] for r in e.transform(df, "p").collect()} for e in (a, b))
        assert len(x) == 300 and all(abs(x[k] - y[k]) < 1e-9 for k in x)
    nodes = a.nodes(spark)
    assert nodes.filter("left_node < 0").count() == nodes.filter("left_node >= 0").count() + 25
    assert nodes.filter("left_node >= 0").agg(F.min("cover")).first()[0] >= 2


def test_boosters_over_a_large_table_replay_no_trees(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"k{i}", i, float(rng.integers(0, 2)), str(rng.choice(["a", "b", "c"])) if i % 9 else None, float(rng.integers(0, 40)) if i % 7 else None,
             float(rng.integers(0, 400))) for i in range(500)]
    df = spark.createDataFrame(rows, "external_id string, row_index bigint, label double, c string, n double, m double").repartition(3)
    layout = T.fit_layout(df, ["c"], ["n", "m"])
    specs = [T.Spec(0, "gbt", True, (("max_iter", 4), ("min_samples_leaf", 5), ("max_leaf_nodes", 6))), T.Spec(1, "gbt", False, (("max_iter", 3),), 150),
             T.Spec(2, "gbt", True, (("max_iter", 3), ("max_leaf_nodes", None), ("max_depth", 3), ("l2_regularization", 1.0)), 200), T.Spec(3, "gbt", False, (("max_iter", 2),), 3)]
    local, spread = T.fit_models(df, layout, specs), {}
    passes, scores, one, other = [], [], T._pass, T._scored
    monkeypatch.setattr(T, "_pass", lambda *a: (passes.append(len(a[3])), one(*a))[1])
    monkeypatch.setattr(T, "_scored", lambda *a: (scores.append(len(a[5])), other(*a))[1])
    for collected, every in ((T.COLLECTED, 20), (0, 3)):  # added up on the driver, and in a shuffle
        monkeypatch.setattr(T, "COLLECTED", collected)
        monkeypatch.setattr(T, "STATE_EVERY", every)
        monkeypatch.setattr(T, "PACKED_ROWS", 30 * every)
        spread = T.fit_models(df, layout, specs, local_bytes=0)
        assert scores == [4, 4, 3, 1]  # the bases, then one tree of every booster that goes on
        scores.clear()
        for a, b in zip(local, spread, strict=True):
            assert a.spec == b.spec and len(a.trees) == len(b.trees) and abs(a.base - b.base) < 1e-9
            for (_, x), (_, y) in zip(a.trees, b.trees):
                assert (x.feature == y.feature).all() and (x.bin == y.bin).all() and np.allclose(x.value, y.value, atol=1e-9) and (x.cover == y.cover).all()


def test_plans_over_a_large_table_do_not_grow_with_the_rounds(spark, monkeypatch):
    """The text of the plan of a round's rows doubled with every round and filled the driver."""
    rng = np.random.default_rng(9)
    rows = [(f"k{i}", i, float(rng.integers(0, 2)), str(rng.choice(["a", "b"])), float(rng.integers(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "external_id string, row_index bigint, label double, c string, n double").repartition(2)
    sizes, one = [], T._pass
    monkeypatch.setattr(T, "_pass", lambda state, *a: (sizes.append(len(state._jdf.queryExecution().toString())), one(state, *a))[1])
    layout, spec = T.fit_layout(df, ["c"], ["n"]), T.Spec(0, "gbt", True, (("max_iter", 8), ("max_leaf_nodes", 2)))
    assert len(T.fit_models(df, layout, [spec], local_bytes=0)[0].trees) == 8
    assert max(sizes) < 2 * min(sizes)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_no_histograms_at_the_depth_limit():
    layout, codes, _, y = data(3)
    rows = T._Rows(layout, T.Spec(0, "gbt", True), codes, y, np.arange(len(y)))
    rows.begin(0.0)
    rows.fill = np.zeros(4, np.int64)
    model = T.grow(layout, T.Rules(max_depth=2, sign=-1.0), rows.fill)
    ask, asked = next(model), []
    with pytest.raises(StopIteration) as end:
        while True:
            asked.append(len(ask.nodes))
            ask = model.send(rows.answer(0, ask))
    assert asked == [1, 1] and (end.value.value.left < 0).sum() == 4 and end.value.value.cover[end.value.value.left < 0].sum() == len(y)


@pytest.mark.parametrize("cells", [1, 60, 4096])
def test_leaf_masks_find_the_leaf_that_the_splits_lead_to(monkeypatch, cells):
    monkeypatch.setattr(T, "JOINT_CELLS", cells)
    layout, codes, _, y = data(4, 3000)
    for leaves in (1, 2, 31, 64, 65):
        spec = T.Spec(0, "gbt", True, (("max_iter", 1), ("max_leaf_nodes", leaves), ("min_samples_leaf", 2)))
        fitted = T.fit_rows(layout, spec, [0], codes, y, np.arange(len(y)))
        tree = fitted.trees[0][1]
        rows = T._Rows(layout, spec, codes, y, np.arange(len(y)), brief=True)
        rows.fill, rows.masks = fitted.fill, T.leaf_masks(layout, tree, fitted.fill)
        assert (rows.masks is None) == ((tree.left < 0).sum() > 64)
        rows.node = np.zeros(len(y), np.int32)
        rows._route(tree)
        assert (rows.node == tree.leaves(T.with_fill(codes, layout, fitted.fill), layout)).all() and (tree.left < 0).sum() == leaves


def test_histograms_by_combination_equal_those_by_feature(monkeypatch):
    layout, codes, _, y = data(9, 3000)
    rng = np.random.default_rng(1)
    rows, w = np.flatnonzero(rng.random(3000) < 0.7), rng.random(3000)
    index = rng.integers(0, 5, len(rows))
    got = {}
    for cells in (1, 40, 600):  # no groups, some, all in one
        monkeypatch.setattr(T, "JOINT_CELLS", cells)
        got[cells] = T.histogram(layout, codes, T.joint_codes(layout, codes), rows, index, 5, (w[rows], None))
    assert sorted(f for g in T.joint_features(layout) for f in g) == list(range(4)) and np.allclose(got[1], got[40]) and np.allclose(got[1], got[600])
    assert (got[1][..., 0] == got[1][..., 2]).all()
    for f in range(4):
        for b in range(layout.sizes[f]):
            hit = codes[rows, f] == b
            assert np.allclose(got[600][:, layout.offset[f] + b, 1], np.bincount(index[hit], weights=w[rows][hit], minlength=5))


def test_scoring_in_shards_and_spread(spark):
    layout, codes, _, y = data(6, 120)
    fitted = T.fit_rows(layout, T.Spec(0, "rf", True, (("min_samples_leaf", 4),)), range(12), codes, y, np.arange(120))
    e = T.Ensemble(layout, fitted.spec, [fitted])
    text = lambda f, k: layout.levels[f][k]
    rows = [(i, text(0, c[0]), text(1, c[1]), *(None if k == len(cu) else cu[k] for k, cu in zip(c[2:], layout.cuts))) for i, c in enumerate(codes.tolist())]
    df = spark.createDataFrame(rows, "id int, c0 string, c1 string, n0 double, n1 double")
    filled = T.with_fill(codes, layout, fitted.fill)
    each = np.stack([t.value[t.leaves(filled, layout)] for _, t in fitted.trees])
    for limit in (10**6, 40):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(T, "SHARD_NODES", limit)
            got = {r["id"]: r for r in e.transform(df, "p", "sd").collect()}
        assert all(abs(got[i]["p"] - each[:, i].mean()) < 1e-12 and abs(got[i]["sd"] - each[:, i].std(ddof=1)) < 1e-7 for i in range(120))
    odd = spark.createDataFrame([(1, "new level", None, None, 1e9), (2, None, "x", -5.0, float("nan"))], df.schema)
    assert all(0 <= r["p"] <= 1 for r in e.transform(odd, "p").collect()) and e.transform(df.limit(0), "p").count() == 0


def test_stored_forest_scores_like_the_one_in_memory(spark, monkeypatch, tmp_path):
    from docket.operators import shap as SH

    layout, codes, _, y = data(6, 120)
    text = lambda f, k: layout.levels[f][k]
    rows = [(i, str(i), i, float(y[i]), text(0, c[0]), text(1, c[1]), *(None if k == len(cu) else cu[k] for k, cu in zip(c[2:], layout.cuts))) for i, c in enumerate(codes.tolist())]
    df = spark.createDataFrame(rows, "id int, external_id string, row_index bigint, label double, c0 string, c1 string, n0 double, n1 double")
    specs = [T.Spec(m, "rf", True, (("n_estimators", 25), ("min_samples_leaf", 4)), below) for m, below in enumerate((None, 90))]
    held = T.fit_models(df, layout, specs)
    monkeypatch.setattr(T, "grow_in_tasks", None)  # brings every tree to the driver
    stored = T.fit_stored(df, layout, specs)
    monkeypatch.setattr(T, "CHUNK_ROWS", 50)
    monkeypatch.setattr(T, "GROUP_ROWS", 60)
    forest = stored[0]
    forest.save_to(f"{tmp_path}/f")
    for m, forest in enumerate((T.load_forest(spark, f"{tmp_path}/f"), stored[1])):
        e = T.Ensemble.of(layout, held, m)
        want = {r["id"]: r for r in e.transform(df, "p", "sd").collect()}
        got = {r["id"]: r for r in forest.transform(df, "p", "sd").collect()}
        assert len(got) == 120 and all(abs(got[i]["p"] - r["p"]) < 1e-12 and abs(got[i]["sd"] - r["sd"]) < 1e-7 and got[i]["c0"] == r["c0"] for i, r in want.items())
        assert forest.transform(df.limit(0), "p").count() == 0
        a, b = ({(r["id"], r["feature"]): r for r in SH.ensemble_shap(df, x, "id").collect()} for x in (e, forest))
        assert a.keys() == b.keys() and all(abs(a[k]["contribution"] - b[k]["contribution"]) < 1e-10 and abs(a[k]["base_value"] - b[k]["base_value"]) < 1e-10 for k in a)
