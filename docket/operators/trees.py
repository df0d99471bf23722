"""Histogram trees: forests of any depth and leaf-wise gradient boosting.

Features are binned once (:class:`Layout`): a category is its level, a number its place among at most 255
values or quantile cuts.  A split looks at one one-hot column (one level against all others) or one cut of a number, so trees are
those of the one-hot encoded table.  Growing needs nothing but histograms: per node and bin the number of
rows and the sums of gradients and weights.  Therefore a model is a *generator* that asks for the histograms of some nodes,
receives them and chooses splits; it never sees a row.  Of two siblings only the smaller is asked for, the other is the difference to
the parent.  Who adds the histograms up is decided by the size of the binned table:

* beyond ``LOCAL_BYTES`` all models of a flow (folds, candidates, blocks of trees) advance side by side, and one pass over the
  table, which is kept in packed chunks of rows, answers the requests of all of them (:func:`grow_on_table`);
* a small table travels to the tasks, a task per model or block of trees (:func:`grow_in_tasks`).

Both run the same generators, so they give the same trees.  Bootstrap weights are Poisson(1) draws from a hash of row and tree, hence
independent of the partitioning.  Fitted trees are rows of a table (one per node).

A forest with a limit on the rows of a leaf grows with its data.  Therefore the flows keep it as a stored table, a row per tree
(:class:`StoredForest`): tasks write their trees there, and scoring meets them with chunks of rows in a shuffle.
"""

from __future__ import annotations

import dataclasses
import heapq
import json
from collections.abc import Generator, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.java_gateway import JavaObject
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket import config as C

MAX_BINS = 255
LOCAL_BYTES = 64 << 20  # binned tables up to this size are sent to the tasks
BLOCK_TREES = 20  # trees of a forest grown by one task, or side by side over a large table
STATE_EVERY = 20  # boosting rounds after which the rows of a large table and their scores are checkpointed
NODES_AT_ONCE = 4096  # histograms held at a time
PACKED_ROWS = 1 << 17  # rows of a large table that are packed together
JOINT_CELLS = 4096  # combinations of bins of several features that are counted together
TASK_ROWS = 1 << 19  # rows of a large table in a partition at most
COLLECTED = 1 << 21  # histogram cells that tasks send to the driver at once (at most 64 MB); beyond, they are added up in a shuffle
MIN_HESSIAN = 1e-3
TIE = 1e-10  # gains closer than this share count as equal; the first column wins


# --- binning ---------------------------------------------------------------------------------
@dataclasses.dataclass
class Layout:
    """Bins of all features: levels of categories, values or cuts of numbers (the last bin of a number holds NULL)."""

    categorical: list[str]
    numeric: list[str]
    levels: list[list[str]]
    cuts: list[list[float]]
    exact: list[bool]

    def __post_init__(self):
        self.sizes = [len(x) + 1 for x in self.levels] + [len(x) + 1 for x in self.cuts]  # one more: unknown level, NULL
        self.offset = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.bins, n_cat = int(self.offset[-1]), len(self.categorical)
        self.feature = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.is_cat = np.arange(len(self.sizes)) < n_cat
        column, at = np.zeros(self.bins, np.int64), 0
        for f, size in enumerate(self.sizes):
            span = slice(self.offset[f], self.offset[f + 1])
            column[span] = at + np.arange(size) if self.is_cat[f] else at
            at += size - 1 if self.is_cat[f] else 1
        self.column, self.columns = column, at
        self.last = self.offset[1:] - 1  # unknown level or NULL
        self.open = np.ones(self.bins, bool)  # bins that a split may name
        self.open[self.last] = False
        for f in np.flatnonzero(~self.is_cat):
            self.open[max(self.last[f] - 1, self.offset[f])] = False  # nothing lies beyond the largest value

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        """(row, feature) bins of a batch with the raw feature columns."""
        out = np.empty((batch.num_rows, len(self.sizes)), dtype=np.int32)
        for f, (name, levels) in enumerate(zip(self.categorical, self.levels)):
            at = pc.index_in(pc.fill_null(batch.column(name), C.MISSING_CODE), pa.array(levels, pa.string()))
            out[:, f] = pc.fill_null(at, len(levels)).to_numpy(zero_copy_only=False)
        for j, (name, cuts) in enumerate(zip(self.numeric, self.cuts)):
            x = batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            code = np.minimum(np.searchsorted(np.array(cuts), x), max(len(cuts) - 1, 0))
            out[:, len(self.categorical) + j] = np.where(np.isnan(x), len(cuts), code)
        return out


def fit_layout(train: DataFrame, categorical: Sequence[str] = C.CATEGORICAL_FEATURES, numeric: Sequence[str] = C.NUMERIC_FEATURES) -> Layout:
    """Levels of the categories and values (or, beyond ``MAX_BINS`` different ones, quantile cuts) of the numbers; one row per bin is read back."""
    levels = [sorted(r[0] for r in train.select(F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_CODE)).alias(c)).distinct().collect()) for c in categorical]
    cuts, exact = [], []
    for c in numeric:
        x = F.col(c).cast("double")
        some = [r[0] for r in train.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("x")).distinct().limit(MAX_BINS + 1).collect()]
        exact.append(len(some) <= MAX_BINS)
        if not exact[-1]:
            share = [(i + 1) / MAX_BINS for i in range(MAX_BINS)]
            some = sorted(set(train.select(x.alias("x")).approxQuantile("x", share, 1e-4)))
        cuts.append(sorted(some))
    return Layout(list(categorical), list(numeric), levels, cuts, exact)


def binned(df: DataFrame, layout: Layout, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and ``codes`` (array of bins)."""
    kept = list(keep)
    src = df.select(*kept, *[F.col(c).cast("string").alias(f"f_{c}") for c in layout.categorical], *[F.col(c).cast("double").alias(f"f_{c}") for c in layout.numeric])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"f_{c}" for c in [*layout.categorical, *layout.numeric]]
        for b in batches:
            raw = pa.RecordBatch.from_arrays([b.column(n) for n in names], [n[2:] for n in names])
            codes = layout.codes(raw)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], lists], [*kept, "codes"])

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in kept) + ", codes array<int>")


# --- growing one tree ------------------------------------------------------------------------
@dataclasses.dataclass
class Tree:
    """Nodes as columns; ``left`` is -1 at leaves.  A row goes right if its bin is ``bin`` (category) or beyond it (number)."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # rows
    weight: np.ndarray  # their weights

    def leaves(self, codes: np.ndarray, layout: Layout) -> np.ndarray:
        node = np.zeros(len(codes), dtype=np.int64)
        live = np.flatnonzero(self.left[node] >= 0)
        while len(live):
            at = node[live]
            f = self.feature[at]
            x = codes[live, f]
            right = np.where(layout.is_cat[f], x == self.bin[at], x > self.bin[at])
            node[live] = np.where(right, self.right[at], self.left[at])
            live = live[self.left[node[live]] >= 0]
        return node


@dataclasses.dataclass(frozen=True)
class Rules:
    """When and how a node is split."""

    min_leaf: int = 1
    min_split: int = 2
    max_depth: int | None = None
    max_leaves: int | None = None
    l2: float = 0.0
    min_weight: float = 0.0
    columns: int | None = None  # columns tried per node (None: all)
    seed: int = 0
    shrink: float = 1.0  # of the leaf values
    sign: float = 1.0  # leaf value is sign * shrink * G / (H + l2)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def best_splits(hist: np.ndarray, layout: Layout, rules: Rules, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (gain, bin, statistics of the left side) per node; gain 0 where no split is allowed.  ``hist``: (node, bin, [rows, G, H])."""
    total = hist[:, layout.offset[0]:layout.offset[1]].sum(axis=1)  # every row is in one bin of the first feature
    left = np.empty_like(hist)
    for f in range(len(layout.sizes)):
        span = slice(layout.offset[f], layout.offset[f + 1])
        left[:, span] = total[:, None] - hist[:, span] if layout.is_cat[f] else np.cumsum(hist[:, span], axis=1)
    right = total[:, None] - left
    allowed = (layout.open & (np.minimum(left[..., 0], right[..., 0]) >= max(rules.min_leaf, 1))
               & (np.minimum(left[..., 2], right[..., 2]) >= max(rules.min_weight, 1e-12)) & (total[:, None, 0] >= rules.min_split))
    if rules.columns is not None and rules.columns < layout.columns:
        allowed &= _tried(allowed, layout, rules, nodes)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = lambda s: s[..., 1] ** 2 / (s[..., 2] + rules.l2)
        own = score(total)
        gain = np.where(allowed, score(left) + score(right) - own[:, None], 0.0)
    gain[~(gain > TIE * np.abs(own)[:, None] + 1e-14)] = 0.0
    best = gain.max(axis=1)
    at = (gain >= best[:, None] * (1 - TIE)).argmax(axis=1)
    return best, at, left[np.arange(len(hist)), at]


def _tried(allowed: np.ndarray, layout: Layout, rules: Rules, nodes: np.ndarray) -> np.ndarray:
    """The bins of each node's random columns: the first ``columns`` of a random order, or the first one beyond them that can be split."""
    key = (nodes[:, None].astype(np.uint64) * np.uint64(layout.columns) + np.arange(layout.columns, dtype=np.uint64)) ^ _scramble(np.full(1, rules.seed + 1, np.uint64))
    order = np.argsort(_scramble(key), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(layout.columns)[None, :], axis=1)
    usable = np.full((len(nodes), layout.columns), layout.columns)
    rows, bins = np.nonzero(allowed)
    usable[rows, layout.column[bins]] = place[rows, layout.column[bins]]
    limit = np.maximum(usable.min(axis=1), rules.columns - 1)  # at least one column that can be split
    return place[:, layout.column] <= limit[:, None]


@dataclasses.dataclass
class Ask:
    """Request of a generator: the tree so far (rows are routed through it) and the nodes whose histograms it needs."""

    tree: Tree
    nodes: np.ndarray


class _Growing:
    def __init__(self):
        self.cols: dict[str, list] = {k: [] for k in ("feature", "bin", "left", "right", "depth", "gain", "cut")}
        self.stats: list[np.ndarray] = []

    def add(self, depth: int, gain: float, cut: int, stat: np.ndarray) -> int:
        for k, v in zip(("feature", "bin", "left", "right", "depth", "gain", "cut"), (-1, -1, -1, -1, depth, gain, cut)):
            self.cols[k].append(v)
        self.stats.append(stat)
        return len(self.stats) - 1

    def tree(self, value: np.ndarray | None = None) -> Tree:
        c = {k: np.array(self.cols[k], dtype=np.int64) for k in ("feature", "bin", "left", "right")}
        return Tree(**c, value=np.zeros(len(self.stats)) if value is None else value, cover=np.array([s[0] for s in self.stats]), weight=np.array([s[2] for s in self.stats]))


def _merge_missing(hist: np.ndarray, layout: Layout, fill: np.ndarray) -> np.ndarray:
    """NULL numbers count in the bin of the median."""
    for f in np.flatnonzero(~layout.is_cat):
        if layout.sizes[f] > 1:
            hist[:, layout.offset[f] + fill[f]] += hist[:, layout.last[f]]
            hist[:, layout.last[f]] = 0
    return hist


def grow(layout: Layout, rules: Rules, fill: np.ndarray, adjust=None) -> Generator[Ask, np.ndarray, Tree]:
    """One tree.  Without ``max_leaves`` whole levels are split; with it the leaf of the largest gain is split first: all leaves that may
    come to be split are expanded at once, and those that the order of gains does not reach are dropped again.

    ``adjust`` maps histograms before use (class weights).
    """
    g = _Growing()

    def take(hist: np.ndarray) -> np.ndarray:
        hist = _merge_missing(hist, layout, fill)
        return adjust(hist) if adjust else hist

    def found(hist: np.ndarray, ids: np.ndarray, depths: list[int]) -> None:
        gain, cut, left = best_splits(hist, layout, rules, ids)
        for i, n in enumerate(ids.tolist()):
            deep = rules.max_depth is not None and depths[i] >= rules.max_depth
            g.cols["gain"][n], g.cols["cut"][n] = (0.0 if deep else float(gain[i])), int(cut[i])
            sides[n] = left[i]
            if g.cols["gain"][n] > 0:
                hists[n] = hist[i]

    hists: dict[int, np.ndarray] = {}
    sides: dict[int, np.ndarray] = {}
    root = g.add(0, 0.0, -1, np.zeros(3))
    first = take((yield Ask(g.tree(), np.array([root]))))
    g.stats[root] = first[0, layout.offset[0]:layout.offset[1]].sum(axis=0)
    found(first, np.array([root]), [0])
    while True:
        todo = _pending(g, rules)
        if not todo:
            break
        for at in range(0, len(todo), NODES_AT_ONCE):
            part, asked, other, whole = todo[at:at + NODES_AT_ONCE], [], [], []
            for n in part:
                cut = g.cols["cut"][n]
                f = int(layout.feature[cut])
                a, b = sides[n], g.stats[n] - sides[n]
                d = g.cols["depth"][n] + 1
                x, y = g.add(d, 0.0, -1, a), g.add(d, 0.0, -1, b)
                g.cols["feature"][n], g.cols["bin"][n] = f, _bin(layout, f, cut, hists[n])
                g.cols["left"][n], g.cols["right"][n] = x, y
                hist = hists.pop(n)
                if rules.max_depth is not None and d >= rules.max_depth:
                    continue  # leaves for certain: nobody needs their histograms
                small, big = (x, y) if a[0] <= b[0] else (y, x)
                asked.append(small)
                other.append(big)
                whole.append(hist)
            if not asked:
                continue
            got = take((yield Ask(g.tree(), np.array(asked))))
            rest = np.stack(whole) - got
            both = np.concatenate([got, rest])
            ids = np.array(asked + other)
            found(both, ids, [g.cols["depth"][n] for n in ids.tolist()])
    return _finished(g, rules)


def _bin(layout: Layout, f: int, cut: int, hist: np.ndarray) -> int:
    """The bin of a split; between two values that occur, a number's threshold is halfway, which other values' bins must follow."""
    b = cut - int(layout.offset[f])
    j = f - len(layout.categorical)
    if j < 0 or not layout.exact[j]:
        return b
    cuts = layout.cuts[j]
    after = np.flatnonzero(hist[cut + 1:layout.last[f], 0] > 0)
    halfway = (cuts[b] + cuts[b + 1 + int(after[0])]) / 2 if len(after) else cuts[b]
    return int(np.searchsorted(np.array(cuts), halfway, side="right")) - 1


def _pending(g: _Growing, rules: Rules) -> list[int]:
    """Nodes to split next."""
    gain, left = g.cols["gain"], g.cols["left"]
    if rules.max_leaves is None:
        return [n for n in range(len(gain)) if gain[n] > 0 and left[n] < 0]
    out, heap, leaves = [], [(-gain[0], 0)], 1
    while heap and leaves < rules.max_leaves:
        s, n = heapq.heappop(heap)
        if s >= 0:
            break
        leaves += 1
        if left[n] < 0:
            out.append(n)
        else:
            for c in (left[n], g.cols["right"][n]):
                heapq.heappush(heap, (-gain[c], c))
    return out


def _finished(g: _Growing, rules: Rules) -> Tree:
    """The tree without expansions that are not part of it, and its leaf values."""
    if rules.max_leaves is not None:
        heap, leaves, inner = [(-g.cols["gain"][0], 0)], 1, set()
        while heap and leaves < rules.max_leaves:
            s, n = heapq.heappop(heap)
            if s >= 0:
                break
            leaves += 1
            inner.add(n)
            for c in (g.cols["left"][n], g.cols["right"][n]):
                heapq.heappush(heap, (-g.cols["gain"][c], c))
        for n in range(len(g.stats)):
            if n not in inner:
                for k in ("left", "right", "feature", "bin"):
                    g.cols[k][n] = -1
    kept, todo = [], [0]
    while todo:
        n = todo.pop(0)
        kept.append(n)
        if g.cols["left"][n] >= 0:
            todo += [g.cols["left"][n], g.cols["right"][n]]
    new = {n: i for i, n in enumerate(kept)}
    stats = np.stack([g.stats[n] for n in kept])
    weight = stats[:, 2] + rules.l2
    value = rules.sign * rules.shrink * np.divide(stats[:, 1], weight, out=np.zeros(len(kept)), where=weight > 0)
    col = {k: np.array([g.cols[k][n] for n in kept], dtype=np.int64) for k in ("feature", "bin")}
    kids = {k: np.array([new.get(g.cols[k][n], -1) for n in kept], dtype=np.int64) for k in ("left", "right")}
    return Tree(**col, **kids, value=value, cover=stats[:, 0], weight=stats[:, 2])


# --- models ----------------------------------------------------------------------------------
@dataclasses.dataclass(frozen=True)
class Spec:
    """A model to fit: kind ``rf`` or ``gbt``, classification or regression, rows of index below ``below`` (None: all)."""

    model: int
    kind: str
    classes: bool
    params: tuple = ()
    below: int | None = None
    log1p: bool = False
    seed: int = 42

    def get(self, name, default):
        value = dict(self.params).get(name, default)
        return value

    @property
    def trees(self) -> int:
        return int(self.get("n_estimators", 100) if self.kind == "rf" else self.get("max_iter", 100))


def _columns(spec: Spec, layout: Layout) -> int | None:
    rule, p = spec.get("max_features", "sqrt" if spec.classes else 1.0), layout.columns
    if rule in (None, 1.0):
        return None
    return max(1, int(np.sqrt(p)) if rule == "sqrt" else int(np.log2(p)) if rule == "log2" else int(float(rule) * p))


def _medians(counts: np.ndarray, layout: Layout) -> np.ndarray:
    """Bin of the median of every number, from the rows per bin (halfway between two values: the bin it falls into)."""
    fill = np.zeros(len(layout.sizes), dtype=np.int64)
    for f in np.flatnonzero(~layout.is_cat):
        n = counts[layout.offset[f]:layout.last[f]]
        if n.sum():
            cuts, cum = np.array(layout.cuts[f - len(layout.categorical)]), np.cumsum(n)
            low, high = (int(np.searchsorted(cum, k, side="right")) for k in ((n.sum() - 1) // 2, n.sum() // 2))
            fill[f] = min(int(np.searchsorted(cuts, (cuts[low] + cuts[high]) / 2)), len(cuts) - 1)
    return fill


@dataclasses.dataclass
class Fitted:
    """Trees of a model (or of a block of a forest's trees) and what scoring needs besides."""

    spec: Spec
    trees: list[tuple[int, Tree]]
    fill: np.ndarray
    base: float = 0.0


def fit_forest(layout: Layout, spec: Spec, numbers: Sequence[int]) -> Generator:
    """The trees ``numbers`` of a forest, one after the other.  First asks for the plain root counts of all rows (tree -1)."""
    root = yield (-1, Ask(_stump(), np.array([0])))
    fill = _medians(root[0, :, 0], layout)
    total = root[0, layout.offset[0]:layout.offset[1]].sum(axis=0)
    out = []
    for t in numbers:
        rules = Rules(min_leaf=int(spec.get("min_samples_leaf", 1)), min_split=int(spec.get("min_samples_split", 2)), max_depth=spec.get("max_depth", None),
                      columns=_columns(spec, layout), seed=spec.seed * 1_000_003 + t)
        weight = spec.get("class_weight", None) if spec.classes else None
        drawn = [total] if weight == "balanced" else []  # balanced_subsample: the weights follow the tree's own draw

        def adjust(hist, weight=weight, drawn=drawn):
            if weight is None:
                return hist
            if not drawn:
                drawn.append(hist[0, layout.offset[0]:layout.offset[1]].sum(axis=0))
            _, one, both = drawn[0]
            w1, w0 = (both / (2 * one) if one > 0 else 0.0), (both / (2 * (both - one)) if both > one else 0.0)
            g = hist[..., 1]
            return np.stack([hist[..., 0], w1 * g, w1 * g + w0 * (hist[..., 2] - g)], axis=-1)

        out.append((t, (yield from _tagged(t, grow(layout, rules, fill, adjust)))))
    return Fitted(spec, out, fill)


def fit_boosting(layout: Layout, spec: Spec) -> Generator:
    """Gradient boosting with second-order leaf values: log loss, or squared error."""
    root = yield (-1, Ask(_stump(), np.array([0])))
    fill = _medians(root[0, :, 0], layout)
    n, g, _ = root[0, layout.offset[0]:layout.offset[1]].sum(axis=0)
    mean = g / n if n else 0.0
    share = min(max(mean, 1e-6), 1 - 1e-6)
    fitted = Fitted(spec, [], fill, float(np.log(share / (1 - share)) if spec.classes else mean))
    rules = Rules(min_leaf=int(spec.get("min_samples_leaf", 20)), min_split=2 * int(spec.get("min_samples_leaf", 20)), max_depth=spec.get("max_depth", None),
                  max_leaves=spec.get("max_leaf_nodes", 31), l2=float(spec.get("l2_regularization", 0.0)), min_weight=MIN_HESSIAN,
                  shrink=float(spec.get("learning_rate", 0.1)), sign=-1.0)
    yield ("begin", fitted)
    for t in range(spec.trees):
        tree = yield from _tagged(t, grow(layout, rules, fill))
        fitted.trees.append((t, tree))
        yield ("advance", fitted)
    return fitted


def _stump() -> Tree:
    none = np.full(1, -1, np.int64)
    return Tree(none, none, none, none, np.zeros(1), np.zeros(1), np.zeros(1))


def _tagged(tag: int, inner: Generator) -> Generator:
    """Passes requests on as (tree number, request)."""
    ask = next(inner)
    while True:
        hist = yield (tag, ask)
        try:
            ask = inner.send(hist)
        except StopIteration as end:
            return end.value


def bootstrap(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Poisson(1) draws from row keys and tree number."""
    mark = _scramble(np.full(1, (seed * 1_000_003 + tree) & 0xFFFFFFFF, np.uint64))
    u = (_scramble(keys.view(np.uint64) ^ mark) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.searchsorted(_POISSON, u, side="right").astype(float)


_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(20)])


def joint_features(layout: Layout) -> list[list[int]]:
    """Features in groups whose bins have at most ``JOINT_CELLS`` combinations (a larger one stands alone)."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(layout.sizes)), key=lambda f: -layout.sizes[f]):
        for k, (cells, group) in enumerate(groups):
            if cells * layout.sizes[f] <= JOINT_CELLS:
                groups[k] = (cells * layout.sizes[f], [*group, f])
                break
        else:
            groups.append((layout.sizes[f], [f]))
    return [g for _, g in groups]


def joint_codes(layout: Layout, codes: np.ndarray) -> list[np.ndarray]:
    """For every group of :func:`joint_features`, the rows' combination of bins."""
    out = []
    for group in joint_features(layout):
        at = codes[:, group[0]].astype(np.int32)
        for f in group[1:]:
            at = at * layout.sizes[f] + codes[:, f]
        out.append(at)
    return out


def histogram(layout: Layout, codes: np.ndarray, joint: Sequence[np.ndarray], rows: np.ndarray | None, index: np.ndarray, m: int,
              weights: Sequence[np.ndarray | None]) -> np.ndarray:
    """(node, bin, rows and the sums of both weights; None: 1) of ``rows`` (None: all) in nodes ``index`` (0..m-1).

    Many rows a node are counted by combinations of bins, which are then added up per feature; few rows by every feature on its own.
    """
    out = np.empty((m, layout.bins, 3))
    pick = lambda a: a if rows is None else a[rows]

    def count(group: list[int], at: np.ndarray) -> None:
        sizes = [layout.sizes[f] for f in group]
        cells = int(np.prod(sizes))
        key = index * cells + at
        n = np.bincount(key, minlength=m * cells)
        for k, w in enumerate((None, *weights)):
            part = (n if w is None else np.bincount(key, weights=w, minlength=m * cells)).reshape(m, *sizes)
            for j, f in enumerate(group):
                out[:, layout.offset[f]:layout.offset[f + 1], k] = part.sum(axis=tuple(i + 1 for i in range(len(sizes)) if i != j))

    together = len(index) >= m * JOINT_CELLS
    for group, at in zip(joint_features(layout), joint):
        if together or len(group) == 1:
            count(group, pick(at))
        else:
            for f in group:
                count([f], pick(codes[:, f]))
    return out


def gradients(spec: Spec, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if spec.classes:
        p = 1 / (1 + np.exp(-score))
        return p - y, p * (1 - p)
    return score - y, np.ones(len(y))


def with_fill(codes: np.ndarray, layout: Layout, fill: np.ndarray) -> np.ndarray:
    out = codes.copy()
    for f in np.flatnonzero(~layout.is_cat):
        if layout.sizes[f] > 1:
            out[out[:, f] == layout.sizes[f] - 1, f] = fill[f]
    return out


def _target(spec: Spec, label: np.ndarray) -> np.ndarray:
    return np.log1p(label) if spec.log1p else label


def leaf_masks(layout: Layout, t: Tree, fill: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """The leaves of a tree with at most 64 of them and, for every group of features, the leaves (as bits) that each combination of bins
    may reach: a row is in the one leaf that all groups allow."""
    leaves = np.flatnonzero(t.left < 0)
    if len(leaves) > 64:
        return None
    allowed = {0: [np.ones(n, bool) for n in layout.sizes]}
    for n in np.flatnonzero(t.left >= 0).tolist():  # parents come first
        f, bins = int(t.feature[n]), allowed.pop(n)
        at = np.arange(layout.sizes[f])
        right = at == t.bin[n] if layout.is_cat[f] else at > t.bin[n]
        if not layout.is_cat[f]:
            right[-1] = right[fill[f]]
        for child, side in ((t.left[n], ~right), (t.right[n], right)):
            allowed[int(child)] = [x & side if j == f else x for j, x in enumerate(bins)]
    tables = []
    for group in joint_features(layout):
        table = np.zeros(int(np.prod([layout.sizes[f] for f in group])), np.uint64)
        for k, leaf in enumerate(leaves.tolist()):
            grid = allowed[leaf][group[0]]
            for f in group[1:]:
                grid = np.logical_and.outer(grid, allowed[leaf][f]).reshape(-1)
            table[grid] |= np.uint64(1 << k)
        tables.append(table)
    return leaves, tables


class _Rows:
    """Rows of one task, and where each is in the tree that grows; rows that do not stay with the task (``brief``) answer one request."""

    def __init__(self, layout: Layout, spec: Spec, codes: np.ndarray, label: np.ndarray, keys: np.ndarray, joint: Sequence[np.ndarray] | None = None, brief: bool = False):
        self.layout, self.spec, self.codes, self.y, self.keys, self.brief = layout, spec, codes, _target(spec, label), keys, brief
        self.joint = joint_codes(layout, codes) if joint is None else joint
        self.score, self.fill, self.tag, self.use, self.masks = None, None, None, None, None

    def answer(self, tag: int, ask: Ask) -> np.ndarray:
        if tag == -1:
            return histogram(self.layout, self.codes, self.joint, None, np.zeros(len(self.y), np.int64), 1, (self.y, None))
        if self.fill is None:
            raise RuntimeError("rows without fill values")
        if self.tag != tag:
            self.tag = tag
            if self.score is None:
                c = bootstrap(self.keys, self.spec.seed, tag)
                self.use = np.flatnonzero(c > 0)
                self.weights = ((c * self.y)[self.use], c[self.use])
            elif not self.brief:
                self.weights = self._gradients(slice(None))
            self.node = np.zeros(len(self.y) if self.use is None else len(self.use), np.int32)
        self._route(ask.tree)
        slot = np.full(len(ask.tree.left), -1, np.int64)
        slot[ask.nodes] = np.arange(len(ask.nodes))
        mine = slot[self.node]
        at = np.flatnonzero(mine >= 0)
        rows = at if self.use is None else self.use[at]
        weights = self._gradients(rows) if self.brief and self.score is not None else [None if w is None else w[at] for w in self.weights]
        return histogram(self.layout, self.codes, self.joint, rows, mine[at], len(ask.nodes), weights)

    def _gradients(self, rows) -> tuple[np.ndarray, np.ndarray | None]:
        g, h = gradients(self.spec, self.y[rows], self.score[rows])
        return g, h if self.spec.classes else None  # squared error: all 1

    def _route(self, t: Tree) -> None:
        """Rows in nodes that were split go on to their children (a NULL number as the median)."""
        split = np.flatnonzero(t.left >= 0)
        if not len(split):
            return
        if self.masks is not None:
            leaves, tables = self.masks
            found = None
            for table, at in zip(tables, self.joint):
                may = table[at if self.use is None else at[self.use]]
                found = may if found is None else found & may
            self.node = leaves.astype(np.int32)[np.bitwise_count(found - np.uint64(1))]  # the number of the one bit left
            return
        layout, width = self.layout, max(self.layout.sizes)
        number = np.full(len(t.left), -1, np.int64)
        number[split] = np.arange(len(split))
        f = t.feature[split]
        at, cut = np.arange(width)[None, :], t.bin[split][:, None]
        right = np.where(layout.is_cat[f][:, None], at == cut, at > cut)
        for j in np.flatnonzero(~layout.is_cat[f]):
            right[j, layout.sizes[f[j]] - 1] = right[j, self.fill[f[j]]]
        child = np.where(right, t.right[split][:, None], t.left[split][:, None]).astype(np.int32).reshape(-1)
        inner = np.flatnonzero(number[self.node] >= 0)  # one level at a time: nodes are split as soon as they are asked for
        while len(inner):
            s = number[self.node[inner]]
            x = self.codes[inner if self.use is None else self.use[inner], f[s]]
            self.node[inner] = child[s * width + x]
            inner = inner[number[self.node[inner]] >= 0]

    def begin(self, base: float) -> None:
        self.score = np.full(len(self.y), base)

    def advance(self, t: Tree) -> None:
        """Adds the values of a tree."""
        self.node = np.zeros(len(self.y), np.int32)
        self._route(t)
        self.score += t.value[self.node]


def fit_rows(layout: Layout, spec: Spec, numbers: Sequence[int], codes: np.ndarray, label: np.ndarray, keys: np.ndarray) -> Fitted:
    """Run a model's generator on rows held in memory."""
    rows = _Rows(layout, spec, codes, label, keys)
    model = fit_forest(layout, spec, numbers) if spec.kind == "rf" else fit_boosting(layout, spec)
    tag, ask = next(model)
    try:
        while True:
            if tag == "begin":
                rows.begin(ask.base)
                tag, ask = next(model)
                continue
            if tag == "advance":
                rows.advance(ask.trees[-1][1])
                tag, ask = next(model)
                continue
            hist = rows.answer(tag, ask)
            if tag == -1:
                rows.fill = _medians(hist[0, :, 0], layout)
            tag, ask = model.send(hist)
    except StopIteration as end:
        return end.value


def predict(layout: Layout, fitted: Fitted, codes: np.ndarray) -> np.ndarray:
    """Sum of the trees' values per row (unfilled codes), the boosting base included."""
    filled = with_fill(codes, layout, fitted.fill)
    out = np.full(len(codes), fitted.base)
    for _, t in fitted.trees:
        out += t.value[t.leaves(filled, layout)]
    return out


# --- fits on Spark ---------------------------------------------------------------------------
def _blocks(specs: Sequence[Spec]) -> list[tuple[Spec, list[int]]]:
    """Work items: a booster, or a block of a forest's trees."""
    out = []
    for s in specs:
        numbers = list(range(s.trees))
        out += [(s, numbers[i:i + BLOCK_TREES]) for i in range(0, len(numbers), BLOCK_TREES)] if s.kind == "rf" else [(s, numbers)]
    return out


def table_bytes(table: DataFrame, layout: Layout) -> int:
    return table.count() * (4 * len(layout.sizes) + 24)


def _arrays(table: pa.Table, layout: Layout) -> tuple[np.ndarray, ...]:
    codes = np.asarray(pc.list_flatten(table.column("codes").combine_chunks())).reshape(-1, len(layout.sizes))
    return codes, *(table.column(c).to_numpy().astype(t) for c, t in (("label", float), ("key", np.int64), ("row_index", np.int64)))


def fit_models(train: DataFrame, layout: Layout, specs: Sequence[Spec], local_bytes: int = LOCAL_BYTES) -> list[Fitted]:
    """Fit all ``specs`` on ``train`` (features, ``label``, ``row_index``, ``external_id``); forests come back in blocks of trees."""
    table = _train_table(train, layout)
    if table_bytes(table, layout) <= local_bytes:
        return grow_in_tasks(table, layout, specs)
    return grow_on_table(table, layout, specs)


def _train_table(train: DataFrame, layout: Layout) -> DataFrame:
    return binned(train.select("*", F.xxhash64("external_id").alias("key")), layout, ["label", "key", "row_index"]).checkpoint()


def fit_stored(train: DataFrame, layout: Layout, specs: Sequence[Spec], local_bytes: int = LOCAL_BYTES) -> list[StoredForest]:
    """The forests ``specs``, fitted like :func:`fit_models`; their trees go from the tasks to the checkpoint folder, not through the driver."""
    table = _train_table(train, layout)
    if table_bytes(table, layout) <= local_bytes:
        grown = _in_tasks(table, layout, specs, _stored_trees, STORED)
    else:
        rows = [b for fitted in grow_on_table(table, layout, specs) for b in _stored_trees(0, fitted.spec, fitted)]
        grown = table.sparkSession.createDataFrame(pa.Table.from_batches(rows), STORED)
    return StoredForest.all_of(layout, specs, grown.checkpoint())


def _fitted_blob(item: int, spec: Spec, fitted: Fitted) -> Iterator[pa.RecordBatch]:
    import pickle

    yield pa.RecordBatch.from_arrays([pa.array([item], pa.int64()), pa.array([pickle.dumps(fitted)], pa.binary())], ["item", "fitted"])


def _stored_trees(item: int, spec: Spec, fitted: Fitted) -> Iterator[pa.RecordBatch]:
    import pickle

    for number, t in fitted.trees:
        leaf = t.left < 0
        small = [a.astype(np.int32) for a in (t.feature, t.bin, t.left, t.right)]
        blob = pickle.dumps((*small, t.value, t.cover, t.weight))
        expected = float((t.value[leaf] * t.weight[leaf]).sum() / t.weight[0]) if t.weight[0] else 0.0
        yield pa.RecordBatch.from_arrays(
            [pa.array([spec.model], pa.int32()), pa.array([number], pa.int32()), pa.array([len(t.left)], pa.int64()), pa.array([expected]),
             pa.array([fitted.fill.tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["model", "tree", "nodes", "expected", "fill", "grown"])


def _in_tasks(table: DataFrame, layout: Layout, specs: Sequence[Spec], out, kinds: str) -> DataFrame:
    """The work items of ``specs``, a task each, as ``out`` makes rows of them; the binned table (its size was checked) goes to all tasks."""
    spark = table.sparkSession
    data = table.orderBy("row_index").toArrow()
    rows = spark.sparkContext.broadcast(_arrays(data, layout))
    work = _blocks(specs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, label, keys, index = rows.value
        for b in batches:
            for i in b.column("item").to_pylist():
                spec, numbers = work[i]
                use = slice(None) if spec.below is None else index < spec.below
                c, y, k = codes[use], label[use], keys[use]
                yield from out(i, spec, fit_rows(layout, spec, numbers, c, y, k))

    order = sorted(range(len(work)), key=lambda i: -len(work[i][1]) * (2 if work[i][0].kind == "gbt" else 1))  # the longest first
    items = spark.createDataFrame([(i, k) for k, i in enumerate(order)], "item bigint, place bigint")
    n = min(len(work), 8 * spark.sparkContext.defaultParallelism)
    return items.repartitionByRange(n, "place").select("item").mapInArrow(run, kinds)


def grow_in_tasks(table: DataFrame, layout: Layout, specs: Sequence[Spec]) -> list[Fitted]:
    """A task per work item; models of bounded size are read back."""
    import pickle

    got = _in_tasks(table, layout, specs, _fitted_blob, "item bigint, fitted binary").collect()  # models, not rows
    return [pickle.loads(r["fitted"]) for r in sorted(got, key=lambda r: r["item"])]


def grow_on_table(table: DataFrame, layout: Layout, specs: Sequence[Spec]) -> list[Fitted]:
    """All work items side by side; every pass over the rows answers one request of each.

    Rows are held in packed chunks with the scores of all boosters.  Boosters begin their trees together: when the
    last of them has finished one, the next pass adds the values of all and keeps the new scores, so that no pass replays earlier trees.
    """
    work = _blocks(specs)
    models = [fit_forest(layout, s, n) if s.kind == "rf" else fit_boosting(layout, s) for s, n in work]
    asks, done = {i: next(m) for i, m in enumerate(models)}, {}
    fills: dict[int, np.ndarray] = {}
    state, scored, old, stored = _Kept.of(_chunks(table, layout)), [], [], 0
    while asks:
        waiting = [i for i in sorted(asks) if asks[i][0] in ("begin", "advance")]
        if waiting and all(i in waiting for i in asks if work[i][0].kind == "gbt"):
            more = {i: asks[i][1].base if asks[i][0] == "begin" else asks[i][1].trees[-1][1] for i in waiting}
            for i in waiting:
                _advance(i, models, asks, done, None)
            more = {i: x for i, x in more.items() if i in asks}  # nobody needs the scores of a finished booster
            if more:
                old.append(state)
                rows, scored, stored = _scored(state.rows, layout, work, fills, scored, more), sorted(more), stored + 1
                state = _Kept.of(rows.checkpoint() if stored % STATE_EVERY == 0 else rows)  # a checkpoint cuts the lineage
            continue
        open_ = {i: asks[i] for i in sorted(asks) if i not in waiting}
        hists = _pass(state.rows, layout, work, open_, fills, scored, state.rdd.getNumPartitions())
        while old:
            old.pop().drop()
        for i in open_:
            if asks[i][0] == -1:
                fills[i] = _medians(hists[i][0, :, 0], layout)
            _advance(i, models, asks, done, hists[i])
    for x in (*old, state):
        x.drop()
    return [done[i] for i in range(len(work))]


class _Kept(NamedTuple):
    """Rows that are kept by the executors, on their disks, and the RDD that they are kept as.

    A persisted DataFrame would carry the plans of all that it was made from, initial and final ones: as every round
    builds on the one before, their text doubles with each and fills the driver.  Rows made from an RDD have no such plan.
    """

    rows: DataFrame
    rdd: JavaObject

    @staticmethod
    def of(df: DataFrame) -> _Kept:
        spark = df.sparkSession
        rdd = df._jdf.toJavaRDD().persist(spark.sparkContext._getJavaStorageLevel(StorageLevel.DISK_ONLY))
        return _Kept(DataFrame(spark._jsparkSession.createDataFrame(rdd, df._jdf.schema()), spark), rdd)

    def drop(self) -> None:
        self.rdd.unpersist(False)


def _advance(i: int, models: list, asks: dict, done: dict, hist) -> None:
    try:
        asks[i] = models[i].send(hist)
    except StopIteration as end:
        done[i] = end.value
        del asks[i]


CHUNK = "codes binary, label binary, key binary, row_index binary, scores binary"


def _chunks(table: DataFrame, layout: Layout) -> DataFrame:
    """The binned rows as packed arrays, a row per ``PACKED_ROWS`` or somewhat more of them; every task that runs at once has a partition."""
    small = np.min_scalar_type(max(layout.sizes))
    at_once = max(1, table.sparkSession.sparkContext.defaultParallelism)
    n = at_once * max(1, -(-table.count() // (TASK_ROWS * at_once)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append([b.column("codes").flatten().to_numpy(zero_copy_only=False).astype(small),
                         *(b.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("label", float), ("key", np.int64), ("row_index", np.int64)))])
            rows += b.num_rows
            if rows >= PACKED_ROWS:
                yield _packed_row(*[np.concatenate(c).tobytes() for c in zip(*held)], b"")
                held, rows = [], 0
        if rows:
            yield _packed_row(*[np.concatenate(c).tobytes() for c in zip(*held)], b"")

    return table.repartition(n).mapInArrow(run, CHUNK)


def _packed_row(*blobs: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], [f.split()[0] for f in CHUNK.split(", ")])


def _unpacked(layout: Layout, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(codes, label, key, row index, scores (row, item)) of every chunk."""
    small = np.min_scalar_type(max(layout.sizes))
    for b in batches:
        for i in range(b.num_rows):
            codes, label, key, index, scores = (b.column(c)[i].as_buffer() for c in range(5))
            n = len(label) // 8
            yield (np.frombuffer(codes, small).reshape(n, -1), np.frombuffer(label, float), np.frombuffer(key, np.int64), np.frombuffer(index, np.int64),
                   np.frombuffer(scores, float).reshape(-1, n))


def _part(layout: Layout, spec: Spec, chunk: tuple, joint: Sequence[np.ndarray]) -> tuple[np.ndarray | slice, _Rows]:
    """The rows of a chunk that a model is fitted on."""
    codes, label, key, index, _ = chunk
    if spec.below is None or (len(index) and index.max() < spec.below):
        return slice(None), _Rows(layout, spec, codes, label, key, joint, brief=True)
    use = np.flatnonzero(index < spec.below)
    return use, _Rows(layout, spec, codes[use], label[use], key[use], [j[use] for j in joint], brief=True)


class _Masks:
    """:func:`leaf_masks` of several trees, made in a task for the first chunk that is long enough."""

    def __init__(self, layout: Layout, trees: dict[int, Tree], fills: dict[int, np.ndarray]):
        self.layout, self.trees, self.fills, self.made = layout, trees, fills, {}

    def of(self, i: int, rows: int):
        if rows < 4 * JOINT_CELLS or i not in self.trees:
            return None
        if i not in self.made:
            self.made[i] = leaf_masks(self.layout, self.trees[i], self.fills[i])
        return self.made[i]


def _pass(state: DataFrame, layout: Layout, work: list, asks: dict, fills: dict, scored: list[int], tasks: int) -> dict[int, np.ndarray]:
    """Histograms that every open item asks for, in one pass of ``tasks`` tasks (node x bin rows per item are read back)."""
    wanted = {i: (tag, ask) for i, (tag, ask) in asks.items()}
    size = {i: len(ask.nodes) * layout.bins for i, (_, ask) in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        masks = _Masks(layout, {i: ask.tree for i, (tag, ask) in wanted.items() if tag != -1}, fills)
        for chunk in _unpacked(layout, batches):
            joint = joint_codes(layout, chunk[0])
            for i, (tag, ask) in wanted.items():
                use, rows = _part(layout, work[i][0], chunk, joint)
                if not len(rows.y):
                    continue
                if tag != -1:
                    rows.fill, rows.masks = fills[i], masks.of(i, len(rows.y))
                    if i in scored:
                        rows.score = chunk[4][scored.index(i)][use]
                hist = rows.answer(tag, ask)
                sums[i] = hist if i not in sums else sums[i] + hist
        for i, hist in sums.items():
            flat = hist.reshape(-1, 3)
            at = np.flatnonzero(flat[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), *[pa.array(flat[at, k]) for k in range(3)]], ["item", "at", "n", "g", "h"])

    got = state.mapInArrow(run, "item bigint, at bigint, n double, g double, h double")
    if sum(size.values()) * tasks > COLLECTED:
        got = got.groupBy("item", "at").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    got = got.toArrow()
    item, at = got.column("item").to_numpy(), got.column("at").to_numpy()
    first = np.cumsum([0, *size.values()])
    place = np.zeros(max(size) + 1, np.int64)
    place[list(size)] = first[:-1]
    total = np.stack([np.bincount(place[item] + at, weights=got.column(c).to_numpy(), minlength=int(first[-1])).astype(float) for c in "ngh"], axis=1)
    return {i: total[a:b].reshape(-1, layout.bins, 3) for i, a, b in zip(size, first[:-1], first[1:])}


def _scored(state: DataFrame, layout: Layout, work: list, fills: dict, scored: list[int], more: dict) -> DataFrame:
    """The chunks with the scores of the boosters ``more``: their base, or their scores so far and the values of a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _Masks(layout, {i: x for i, x in more.items() if isinstance(x, Tree)}, fills)
        for chunk in _unpacked(layout, batches):
            codes, label, key, index, scores = chunk
            joint = joint_codes(layout, codes)
            new = np.empty((len(more), len(label)))
            for at, (i, x) in enumerate(sorted(more.items())):
                if isinstance(x, Tree):
                    rows = _Rows(layout, work[i][0], codes, label, key, joint, brief=True)
                    rows.fill, rows.masks, rows.score = fills[i], masks.of(i, len(label)), scores[scored.index(i)].copy()
                    rows.advance(x)
                    new[at] = rows.score
                else:
                    new[at] = x
            yield _packed_row(*[a.tobytes() for a in (codes, label, key, index, new)])

    return state.mapInArrow(run, CHUNK)


# --- the fitted ensemble ---------------------------------------------------------------------
NODES = "model int, tree int, node int, feature int, bin int, left_node int, right_node int, value double, cover double, weight double"
SHARD_NODES = 2_000_000  # nodes sent to the tasks at once


@dataclasses.dataclass
class Ensemble:
    """A fitted forest or booster."""

    layout: Layout
    spec: Spec
    parts: list[Fitted]

    @staticmethod
    def of(layout: Layout, fits: Sequence[Fitted], model: int) -> Ensemble:
        parts = [f for f in fits if f.spec.model == model]
        return Ensemble(layout, parts[0].spec, parts)

    def nodes(self, spark) -> DataFrame:
        """One row per node."""
        trees = [(t, tree) for p in self.parts for t, tree in p.trees]
        join = lambda k: np.concatenate([getattr(tree, k) for _, tree in trees])
        sizes = [len(tree.left) for _, tree in trees]
        cols = [np.full(sum(sizes), self.spec.model), np.repeat([t for t, _ in trees], sizes), np.concatenate([np.arange(n) for n in sizes]),
                *[join(k) for k in ("feature", "bin", "left", "right")]]
        cols = [c.astype(np.int32) for c in cols] + [join(k).astype(float) for k in ("value", "cover", "weight")]
        return spark.createDataFrame(pa.table(dict(zip([f.split()[0] for f in NODES.split(", ")], cols))))

    def save_to(self, path: str) -> None:
        """The node table and, as one JSON line, bins and parameters below the new folder ``path``."""
        spark = _session()
        self.nodes(spark).write.parquet(f"{path}/nodes")
        lay = {k: getattr(self.layout, k) for k in ("categorical", "numeric", "levels", "cuts", "exact")}
        record = {"layout": lay, "spec": dataclasses.asdict(self.spec), "fill": [int(x) for x in self.parts[0].fill], "base": self.parts[0].base}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(f"{path}/record")

    def _shards(self) -> list[list[Tree]]:
        out, size = [[]], 0
        for p in self.parts:
            for _, t in p.trees:
                if size and size + len(t.left) > SHARD_NODES:
                    out, size = [*out, []], 0
                out[-1].append(t)
                size += len(t.left)
        return out

    def transform(self, df: DataFrame, out_col: str, std_col: str | None = None) -> DataFrame:
        """``df`` with the model's output (probability or value) and, on request, the sample deviation of its trees' outputs.

        Trees travel to the tasks; beyond ``SHARD_NODES`` nodes they do so in shards, a pass each, and the rows carry their sums along.
        """
        layout, fill, count = self.layout, self.parts[0].fill, sum(len(p.trees) for p in self.parts)
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
        kind = rows.schema["row"].dataType.simpleString()
        for shard in self._shards():
            sent = df.sparkSession.sparkContext.broadcast(shard)  # at most SHARD_NODES nodes

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                trees = sent.value
                for b in batches:
                    row = b.column("row")
                    raw = pa.RecordBatch.from_arrays(
                        [pc.struct_field(row, c).cast(pa.string() if c in layout.categorical else pa.float64()) for c in [*layout.categorical, *layout.numeric]],
                        [*layout.categorical, *layout.numeric])
                    codes = with_fill(layout.codes(raw), layout, fill)
                    s, q = b.column("s").to_numpy().copy(), b.column("q").to_numpy().copy()
                    for t in trees:
                        v = t.value[t.leaves(codes, layout)]
                        s += v
                        q += v * v
                    yield pa.RecordBatch.from_arrays([row, pa.array(s), pa.array(q)], ["row", "s", "q"])

            rows = rows.mapInArrow(run, f"row {kind}, s double, q double")
        raw = F.col("s") / count if self.spec.kind == "rf" else F.col("s") + F.lit(float(self.parts[0].base))
        out = 1 / (1 + F.exp(-raw)) if self.spec.kind == "gbt" and self.spec.classes else F.expm1(raw) if self.spec.log1p else raw
        extra = [] if std_col is None else [F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / count) / max(count - 1, 1), F.lit(0.0))).alias(std_col)]
        return rows.select("row.*", out.alias(out_col), *extra)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def load_ensemble(spark, path: str) -> Ensemble:
    """The ensemble that :meth:`Ensemble.save_to` wrote."""
    record = json.loads(spark.read.text(f"{path}/record").first()["value"])
    layout = Layout(**record["layout"])
    spec = Spec(**{**record["spec"], "params": tuple((k, v) for k, v in record["spec"]["params"])})
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree", "node").toArrow()  # a model, not rows
    tree = nodes.column("tree").to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], np.diff(tree) != 0, [True]]))
    cols = {k: nodes.column(c).to_numpy() for k, c in (("feature", "feature"), ("bin", "bin"), ("left", "left_node"), ("right", "right_node"), ("value", "value"), ("cover", "cover"), ("weight", "weight"))}
    trees = [(int(tree[a]), Tree(**{k: (v[a:b] if k in ("value", "cover", "weight") else v[a:b].astype(np.int64)) for k, v in cols.items()})) for a, b in zip(cut[:-1], cut[1:])]
    return Ensemble(layout, spec, [Fitted(spec, trees, np.array(record["fill"], dtype=np.int64), record["base"])])


# --- forests that stay with the tasks --------------------------------------------------------
STORED = "model int, tree int, nodes bigint, expected double, fill array<bigint>, grown binary"
CHUNK_ROWS = 8192  # rows that are scored together
GROUP_ROWS = 1 << 19  # rows that meet a shard of trees in one group
MIN_SHARDS = 32  # parts that a forest is cut into at least, if it has so many trees


def packed(df: DataFrame, layout: Layout) -> DataFrame:
    """``df`` in stored chunks of rows: ``chunk``, ``n``, their ``codes`` as bytes, and the ``rows`` themselves."""
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(c).cast("string").alias(f"f_{c}") for c in layout.categorical],
                    *[F.col(c).cast("double").alias(f"f_{c}") for c in layout.numeric])
    kind, small = src.schema["row"].dataType.simpleString(), np.min_scalar_type(max(layout.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part, seq = [f"f_{c}" for c in [*layout.categorical, *layout.numeric]], TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                b = whole.slice(at, CHUNK_ROWS)
                codes = layout.codes(pa.RecordBatch.from_arrays([b.column(n) for n in names], [n[2:] for n in names])).astype(small)
                rows = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.concat_arrays([b.column("row")]))
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([b.num_rows], pa.int64()), pa.array([codes.tobytes()], pa.binary()), rows],
                                                 ["chunk", "n", "codes", "rows"])
                seq += 1

    return src.mapInArrow(run, f"chunk bigint, n bigint, codes binary, rows array<{kind}>").checkpoint()


@dataclasses.dataclass
class StoredForest:
    """A fitted forest whose trees are rows of ``table`` (see ``STORED``); the driver knows their number and the fill values."""

    layout: Layout
    spec: Spec
    table: DataFrame
    fill: np.ndarray
    count: int
    nodes: int
    expected: float

    @staticmethod
    def all_of(layout: Layout, specs: Sequence[Spec], table: DataFrame) -> list[StoredForest]:
        known = {r["model"]: r for r in table.groupBy("model").agg(F.first("fill").alias("fill"), F.count(F.lit(1)).alias("count"), F.sum("nodes").alias("nodes"),
                                                                   F.avg("expected").alias("expected")).collect()}  # a row per forest
        out = []
        for s in specs:
            r = known[s.model]
            out.append(StoredForest(layout, s, table.where(F.col("model") == s.model), np.array(r["fill"], dtype=np.int64), r["count"], r["nodes"], r["expected"]))
        return out

    def save_to(self, path: str) -> None:
        """The table of trees and, as one JSON line, bins and parameters below the new folder ``path``."""
        self.table.write.parquet(f"{path}/trees")
        lay = {k: getattr(self.layout, k) for k in ("categorical", "numeric", "levels", "cuts", "exact")}
        record = json.dumps({"layout": lay, "spec": dataclasses.asdict(self.spec)})
        self.table.sparkSession.createDataFrame([(record,)], "value string").coalesce(1).write.text(f"{path}/record")

    def over_trees(self, chunks: DataFrame, of_tree, width: int) -> DataFrame:
        """``row`` and ``sums`` (array of ``width`` numbers): ``of_tree(tree)(codes)`` added up over all trees, for every row of :func:`packed` chunks.

        Each shard of trees meets each group of chunks once; a group holds ``GROUP_ROWS`` rows and ``SHARD_NODES`` nodes or one tree.
        """
        layout, fill, small = self.layout, self.fill, np.min_scalar_type(max(self.layout.sizes))
        groups = max(1, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // GROUP_ROWS))
        shards = min(self.count, max(MIN_SHARDS, -(-self.nodes // SHARD_NODES)))
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        left = chunks.select("chunk", "codes", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int").alias("part"), every(shards, "shard"))
        right = self.table.select("tree", "grown", (F.col("tree") % shards).cast("int").alias("shard"), every(groups, "part"))

        def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
            import pickle

            chunk = rows.column("chunk").to_pylist()
            codes = [with_fill(np.frombuffer(c, small).reshape(-1, len(layout.sizes)).astype(np.int32), layout, fill) for c in rows.column("codes").to_pylist()]
            sums = [np.zeros((len(c), width)) for c in codes]
            for i in np.argsort(trees.column("tree").to_numpy()) if chunk else ():
                *whole, value, cover, weight = pickle.loads(trees.column("grown")[int(i)].as_py())
                add = of_tree(Tree(*[a.astype(np.int64) for a in whole], value, cover, weight))
                for s, c in zip(sums, codes):
                    s += add(c)
            shard = rows.column("shard").to_pylist()
            return pa.table({"chunk": pa.array(chunk, pa.int64()), "shard": pa.array(shard, pa.int32()), "sums": pa.array([s.tobytes() for s in sums], pa.binary())})

        keys = ["shard", "part"]
        parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "chunk bigint, shard int, sums binary").checkpoint()

        def add(rows: pa.Table, sums: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(sums.column("sums")[int(i)].as_py()) for i in np.argsort(sums.column("shard").to_numpy()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(total) + 1, width, dtype=np.int32)), pa.array(total))
            return pa.table({"row": rows.column("rows").combine_chunks().flatten(), "sums": lists})

        kind = chunks.schema["rows"].dataType.elementType.simpleString()
        return chunks.select("chunk", "rows").groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(add, f"row {kind}, sums array<double>")

    def transform(self, df: DataFrame, out_col: str, std_col: str | None = None, chunks: DataFrame | None = None) -> DataFrame:
        """``df`` with the forest's output and, on request, the sample deviation of its trees' outputs (X2); ``chunks``: ``df`` packed before."""
        layout, count = self.layout, self.count

        def of_tree(t: Tree):
            def add(codes: np.ndarray) -> np.ndarray:
                v = t.value[t.leaves(codes, layout)]
                return np.stack([v, v * v], axis=1)

            return add

        rows = self.over_trees(packed(df, layout) if chunks is None else chunks, of_tree, 2)
        s, q = F.col("sums")[0], F.col("sums")[1]
        out = F.expm1(s / count) if self.spec.log1p else s / count
        extra = [] if std_col is None else [F.sqrt(F.greatest((q - s * s / count) / max(count - 1, 1), F.lit(0.0))).alias(std_col)]
        return rows.select("row.*", out.alias(out_col), *extra)


def load_forest(spark, path: str) -> StoredForest:
    """The forest that :meth:`StoredForest.save_to` wrote."""
    record = json.loads(spark.read.text(f"{path}/record").first()["value"])
    spec = Spec(**{**record["spec"], "params": tuple((k, v) for k, v in record["spec"]["params"])})
    return StoredForest.all_of(Layout(**record["layout"]), [spec], spark.read.schema(STORED).parquet(f"{path}/trees"))[0]
