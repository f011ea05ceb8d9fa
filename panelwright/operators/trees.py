"""Gradient-boosted regression trees with penalised leaves, grown by levels or best leaf first, for many training sets at once.

Features are cut into bins at their quantiles once. A step of growth is one job: each task adds up the gradients of its
rows by (group, leaf, feature, bin) and Spark adds the tasks' sums, a table whose size hangs on groups, leaves and bins
but not on rows. Rows are packed, tens of thousands of a group in one, so a step reads arrays and has few tasks. The driver finds each leaf's best split in these sums, and splits leaves level by level or always the one
that gains most (a heap). Groups (the folds of a cross-validation, say) share all jobs. Gradients are whole numbers
(units of 2^-30), so sums are exact and trees hang neither on the order of rows nor on repeated tasks.

For squared loss, a leaf with gradient sum G over n rows weighs -T(G) / (n + l2), where T moves G towards zero by l1; a
split must gain more than ``gamma`` of half the sums of T(G)^2 / (n + l2), and leave ``min_rows`` rows on each side. Ties go to the
first feature and the lowest bin. Rows are drawn for a tree by a hash of their number, features by a seeded generator.

A forest grows by the same sums: its trees, many in one job, learn the outcomes themselves from rows drawn with replacement, each
node may split on its own draw of features, and the mean of the trees is the prediction. Its bins end at quantiles of all of a group's rows.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Written

UNIT = 1 << 30
#: Trees grown between rewritings of the predictions so far, at most, and rows times trees.
KEPT, KEPT_ROWS = 25, 1 << 23
#: Rows of the state in one packed row, and in one task of a step, about; so steps have tasks by their rows, not by the input's partitions.
PACK, TASK = 1 << 16, 1 << 17
#: Sums by (group, tree, leaf, feature, bin) that the trees of a forest ask one job for, about.
CELLS = 100_000
#: Columns of the state.
STATE = ["grp", "row", "bins", "y", "f"]


@dataclass(frozen=True)
class Shape:
    """How trees are grown: by levels down to ``depth``, or best leaf first up to ``leaves``; ``bagged`` makes them a forest."""

    rounds: int = 200
    rate: float = 0.03
    depth: int | None = 3
    leaves: int | None = None
    l1: float = 0.5
    l2: float = 2.0
    gamma: float = 0.0
    min_rows: int = 1
    rows: float = 0.7
    columns: float = 0.7
    bins: int = 64
    seed: int = 7
    bagged: bool = False


@dataclass
class Tree:
    """Nodes by number; ``feature`` -1 marks a leaf. A row goes left where its bin is at most ``cut``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        below = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], (self.left[node], self.right[node]) = feature, cut, below
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [x, x]
        return below

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at, todo = np.zeros(len(bins), dtype=np.int64), [(0, np.arange(len(bins)))]
        columns = np.ascontiguousarray(bins.T)
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                at[rows] = node
            elif len(rows):
                goes = columns[self.feature[node]][rows] <= self.cut[node]
                todo += [(self.left[node], rows[goes]), (self.right[node], rows[~goes])]
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(bins)]


@dataclass(frozen=True)
class Booster:
    """``base`` plus the trees' values; ``edges[j]`` are the upper ends of feature j's bins but the last."""

    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        return self.base + sum((t.predict(bins) for t in self.trees), np.zeros(len(x)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)


def _hashed(rows: np.ndarray, tree: int, shape: Shape) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree + 1) * 1_000_003 + shape.seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def drawn(rows: np.ndarray, tree: int, shape: Shape) -> np.ndarray:
    """Which rows, by their numbers, a tree learns from."""
    return _hashed(rows, tree, shape) < np.uint64(int(shape.rows * 2.0**64)) if shape.rows < 1 else np.ones(len(rows), dtype=bool)


#: A row is drawn at least k + 1 times where its hash is at or above the k-th of these; the numbers of times are Poisson ones of mean 1.
_TIMES = np.array([int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**64) for k in range(14)], dtype=np.uint64)


def times_drawn(rows: np.ndarray, tree: int, shape: Shape) -> np.ndarray:
    """How often a forest's tree learns from each row, as if as many rows as there are were drawn with replacement."""
    return np.searchsorted(_TIMES, _hashed(rows, tree, shape), side="right")


def columns_of(tree: int, n: int, shape: Shape) -> list[int]:
    """The features that a tree may split on."""
    k = max(1, round(shape.columns * n))
    return sorted(np.random.default_rng([shape.seed, tree]).permutation(n)[:k].tolist())


def toward_zero(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(sums: np.ndarray, counts: np.ndarray, features: list[int], shape: Shape) -> tuple[float, int, int] | None:
    """(gain, feature, cut) over cumulative sums (feature, bin) of a leaf; None where nothing gains more than gamma."""
    g, n = np.cumsum(sums[features], axis=1) / UNIT, np.cumsum(counts[features], axis=1)
    all_g, all_n = g[:, -1:], n[:, -1:]

    def worth(a, b):
        return toward_zero(a, shape.l1) ** 2 / np.maximum(b + shape.l2, 1e-300)

    gain = 0.5 * (worth(g, n) + worth(all_g - g, all_n - n) - worth(all_g, all_n)) - shape.gamma
    gain[(n < shape.min_rows) | (all_n - n < shape.min_rows) | (n == 0) | (n == all_n)] = -np.inf
    at = int(gain.argmax())
    found = float(gain.flat[at])
    return (found, features[at // gain.shape[1]], at % gain.shape[1]) if found > 1e-12 else None


class _Growth:
    """One group's tree while it grows: which leaves are open, with their sums where known."""

    def __init__(self, number: int, n_features: int, shape: Shape):
        self.tree, self.shape, self.features = Tree(), shape, columns_of(number, n_features, shape)
        self.number = number
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.depth, self.best, self.leaves, self.heap = {0: 0}, {}, 1, []
        self.ahead: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.totals: dict[int, tuple[int, int]] = {}

    def wanted(self) -> tuple[Tree, dict[int, int | tuple[int, int]]]:
        """The tree whose leaves the next job sums up, and what the sums of which leaf are for; nothing where growth is done.

        Best leaf first, sums are also asked for of both sides of every leaf that could be split next, (leaf, side).
        """
        unknown = [k for k, f in enumerate(self.tree.feature) if f < 0 and k not in self.sums and self._open(k)]
        tree, want = copy.deepcopy(self.tree), {k: k for k in unknown}
        if unknown and self.shape.leaves is not None and self.leaves < self.shape.leaves:
            for _, k in self.heap:
                if (k, 0) not in self.ahead:
                    want |= {below: (k, side) for side, below in enumerate(tree.split(k, *self.best[k][1:]))}
        return tree, want

    def _open(self, k: int) -> bool:
        """Whether a leaf may be split; another's sum and count are known from the split that made it."""
        return k == 0 or ((self.shape.depth is None or self.depth[k] < self.shape.depth) and (self.shape.leaves is None or self.leaves < self.shape.leaves))

    def columns(self, k: int) -> list[int]:
        """The features that leaf ``k`` may be split on."""
        if not self.shape.bagged:
            return self.features
        n = len(self.features)
        return sorted(np.random.default_rng([self.shape.seed, self.number, k]).permutation(n)[: math.ceil(math.sqrt(n))].tolist())

    def learn(self, what: int | tuple[int, int], sums: tuple[np.ndarray, np.ndarray]) -> None:
        if isinstance(what, tuple):
            self.ahead[what] = sums
        else:
            self.sums[what] = sums

    def grow(self) -> None:
        """Split all that can be split with the sums at hand."""
        self._look()
        most = self.shape.leaves
        while self.heap and (most is None or self.leaves < most):
            _, k = heapq.heappop(self.heap)
            _, feature, cut = self.best[k]
            below = self.tree.split(k, feature, cut)
            self.leaves += 1
            for b, part in zip(below, (slice(cut + 1), slice(cut + 1, None)), strict=True):
                self.totals[b] = tuple(int(c[feature, part].sum()) for c in self.sums[k])
            for side, b in enumerate(below):
                self.depth[b] = self.depth[k] + 1
                if (k, side) in self.ahead:
                    self.sums[b] = self.ahead.pop((k, side))
            if most is not None:  # the new leaves may gain more than any other: look first
                if below[0] not in self.sums and self._open(below[0]):
                    return
                self._look()

    def _look(self) -> None:
        """Find the best split of leaves whose sums are new."""
        for k in [k for k, f in enumerate(self.tree.feature) if f < 0 and k in self.sums and k not in self.best]:
            deep = self.shape.depth is not None and self.depth[k] >= self.shape.depth
            self.best[k] = None if deep else best_split(*self.sums[k], self.columns(k), self.shape)
            if self.best[k]:
                heapq.heappush(self.heap, (-self.best[k][0], k))

    def finish(self) -> Tree:
        for k, f in enumerate(self.tree.feature):
            if f < 0:
                g, n = self.totals[k] if k else (c[self.features[0]].sum() for c in self.sums[k])
                self.tree.value[k] = float(-self.shape.rate * toward_zero(g / UNIT, self.shape.l1) / max(n + self.shape.l2, 1e-300))
        return self.tree


def _packs(batches: Iterator[pa.RecordBatch], edges: dict[int, list[np.ndarray]], base: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """The state's rows: a group's row numbers, bins, outcomes and predictions, of up to ``PACK`` rows each."""
    held: list[tuple[np.ndarray, ...]] = []

    def packed() -> pa.RecordBatch:
        group, row, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
        out = []
        for g in np.unique(group):
            mine = group == g
            out.append((int(g), row[mine].tobytes(), binned(x[mine], edges[int(g)]).tobytes(), y[mine].tobytes(), np.full(int(mine.sum()), base[int(g)]).tobytes()))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], STATE)

    for batch in batches:
        for start in range(0, batch.num_rows, PACK):
            part = batch.slice(start, PACK)
            x = np.column_stack([part.column(j).to_numpy() for j in range(2, part.num_columns - 1)])
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), x, part.column(part.num_columns - 1).to_numpy()))
            if sum(len(h[0]) for h in held) >= PACK:
                yield packed()
                held = []
    if held:
        yield packed()


def _gradients(batch: pa.RecordBatch, pending: dict[int, list[Tree]], n_features: int):
    """(group, row numbers, bins, predictions, outcomes) of each pack of the state, with the trees since it was written."""
    for group, row, bins, y, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        bins, f = np.frombuffer(bins, np.uint8).reshape(-1, n_features), np.frombuffer(f, np.float64)
        for tree in pending.get(group, []):
            f = f + tree.predict(bins)
        yield group, np.frombuffer(row, np.int64), bins, f, np.frombuffer(y, np.float64)


def _histograms(state: DataFrame, pending: dict[int, list[Tree]], growing: dict[tuple[int, int], _Growth], shape: Shape, n_features: int) -> None:
    """Give each growing tree, named by group and number, the sums and counts by (feature, bin) that it waits for; one job."""
    asked = {key: w.wanted() for key, w in growing.items()}
    wanted = {key: (tree, list(ks)) for key, (tree, ks) in asked.items() if ks}
    shared = state.sparkSession.sparkContext.broadcast((pending, wanted))
    size = n_features * shape.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, wanted = shared.value
        sums = {(*key, k): (np.zeros(size, np.int64), np.zeros(size, np.int64)) for key, (_, ks) in wanted.items() for k in ks}
        groups = {g for g, _ in wanted}
        offset = np.arange(n_features) * shape.bins
        for batch in batches:
            batch = batch.filter(pa.array([g in groups for g in batch.column(0).to_pylist()], pa.bool_()))
            for g, row, bins, f, y in _gradients(batch, pending, n_features):
                gradient = np.rint((f - y) * UNIT)
                for (of, number), (tree, ks) in wanted.items():
                    if of != g:
                        continue
                    times = (times_drawn if shape.bagged else drawn)(row, number, shape)
                    mine = np.flatnonzero(times)
                    leaf = tree.leaf(bins[mine])
                    for k in ks:
                        here = mine[leaf == k]
                        cells = (bins[here] + offset).ravel()
                        often = np.repeat(times[here], n_features) if shape.bagged else None
                        sums[g, number, k][0][:] += np.bincount(cells, weights=np.repeat(gradient[here] * times[here], n_features), minlength=size).astype(np.int64)
                        sums[g, number, k][1][:] += np.bincount(cells, weights=often, minlength=size).astype(np.int64)
        rows = [(*at, int(c), int(s[c]), int(n[c])) for at, (s, n) in sums.items() for c in np.flatnonzero(n)]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (*[pa.int32()] * 4, pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["grp", "tree", "leaf", "cell", "g", "n"])

    found = {(*key, k): (np.zeros(size, np.int64), np.zeros(size, np.int64)) for key, (_, ks) in wanted.items() for k in ks}
    parts = state.mapInArrow(run, "grp int, tree int, leaf int, cell int, g long, n long")
    for g, number, k, cell, total, n in parts.groupBy("grp", "tree", "leaf", "cell").agg(F.sum("g"), F.sum("n")).collect():
        sums, counts = found[g, number, k]
        sums[cell], counts[cell] = total, n
    shared.unpersist()
    for (g, number, k), (s, n) in found.items():
        growing[g, number].learn(asked[g, number][1][k], (s.reshape(n_features, -1), n.reshape(n_features, -1)))


def _grow(state: DataFrame, pending: dict[int, list[Tree]], numbers: range, shape: Shape, n_features: int) -> Iterator[tuple[int, Tree]]:
    """The trees of these numbers of each group; a job for each step of their growth."""
    growing = {(g, number): _Growth(number, n_features, shape) for g in pending for number in numbers}
    while any(w.wanted()[1] for w in growing.values()):
        _histograms(state, pending, growing, shape, n_features)
        for w in growing.values():
            w.grow()
    for (g, _), w in growing.items():
        yield g, w.finish()


def _rewritten(state: Written, pending: dict[int, list[Tree]], n_features: int) -> Written:
    """The state with the pending trees in its predictions; the table before is removed."""
    shared = state.df.sparkSession.sparkContext.broadcast(pending)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [f.tobytes() for _, _, _, f, _ in _gradients(batch, shared.value, n_features)]
            yield pa.record_batch([*batch.columns[:4], pa.array(f, pa.binary())], STATE)

    fresh = Written(state.df.mapInArrow(run, state.df.schema), "boosting")
    state.remove()
    shared.unpersist()
    return fresh


def quantile_edges(rows: DataFrame, features: list[str], bins: int, group: str | None = None) -> dict[int, list[np.ndarray]]:
    """By group (without one, 0), the upper ends of each feature's bins but the last: at most ``bins - 1`` distinct quantiles of all its rows."""
    if not 2 <= bins <= 256:
        raise ValueError("2 to 256 bins")
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    quantiles = [F.percentile_approx(f, at, 10_000).alias(f"q{j}") for j, f in enumerate(features)]
    found = rows.groupBy(group).agg(*quantiles).collect() if group else [(0, *rows.agg(*quantiles).first())]  # a row a group
    return {g: [np.unique(np.array(q if q is not None else [0.0], dtype=float)) for q in qs] for g, *qs in found}


def fit(rows: DataFrame, features: list[str], shape: Shape, group: str | None = None, row: str = "row", y: str = "y") -> dict[int, Booster]:
    """A booster, or a forest, of each value of ``group`` (an integer column; without one, group 0) from its rows; null features count as 0."""
    known = rows.select((F.col(group) if group else F.lit(0)).cast("int").alias("grp"), F.col(row).cast("long").alias("row"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{j}") for j, f in enumerate(features)], F.col(y).cast("double").alias("y"))
    known = known.where("y is not null")
    names, d = [f"x{j}" for j in range(len(features))], len(features)
    means = known.groupBy("grp").agg(F.sum(F.round(F.col("y") * UNIT).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    base = {r["grp"]: float(r["s"]) / r["n"] / UNIT for r in means}
    if not base:
        return {}
    edges = quantile_edges(known, names, shape.bins, "grp") if shape.bagged else dict.fromkeys(base, quantile_edges(known, names, shape.bins)[0])

    packs = known.mapInArrow(lambda batches: _packs(batches, edges, base), "grp int, row binary, bins binary, y binary, f binary")
    n_rows = sum(r["n"] for r in means)
    state = Written(packs.repartition(math.ceil(n_rows / TASK)), "boosting")
    trees: dict[int, list[Tree]] = {g: [] for g in base}
    pending: dict[int, list[Tree]] = {g: [] for g in base}
    if shape.bagged:
        shape = replace(shape, rate=1 / shape.rounds)
        together = max(1, CELLS // (len(base) * d * shape.bins * 2 ** max((shape.depth or 8) - 1, 0)))
        for start in range(0, shape.rounds, together):
            for g, tree in _grow(state.df, pending, range(start, min(start + together, shape.rounds)), shape, d):
                trees[g].append(tree)
        state.remove()
        return {g: Booster(edges[g], base[g], trees[g]) for g in base}
    for number in range(shape.rounds):
        for g, tree in _grow(state.df, pending, range(number, number + 1), shape, d):
            trees[g].append(tree)
            pending[g].append(tree)
        waiting = max(map(len, pending.values()))
        if (waiting >= KEPT or waiting * n_rows >= KEPT_ROWS) and number + 1 < shape.rounds:
            state = _rewritten(state, pending, d)
            pending = {g: [] for g in base}
    state.remove()
    return {g: Booster(edges[g], base[g], trees[g]) for g in base}


def predict(rows: DataFrame, features: list[str], boosters: dict[int, Booster], group: str | None = None) -> DataFrame:
    """``rows`` with ``prediction`` by the booster of their group; null where there is none."""
    shared = rows.sparkSession.sparkContext.broadcast(boosters)

    @F.pandas_udf("double")
    def score(grp: pd.Series, x: pd.Series) -> pd.Series:
        out = np.full(len(grp), np.nan)
        values = np.array(x.tolist(), dtype=float).reshape(len(grp), -1)
        for g in grp.dropna().unique():
            mine = (grp == g).to_numpy()
            if int(g) in shared.value:
                out[mine] = shared.value[int(g)].predict(values[mine])
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    key = F.col(group).cast("int") if group else F.lit(0)
    return rows.withColumn("prediction", score(key, F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])))


#: Level by level with a price on each split, best leaf first with many rows a leaf, and a forest of trees without penalties.
LEVEL_WISE = Shape(depth=3, gamma=1.0)
LEAF_WISE = Shape(depth=None, leaves=7, min_rows=50)
FOREST = Shape(rounds=300, depth=3, l1=0.0, l2=0.0, min_rows=50, rows=1.0, columns=1.0, bins=32, bagged=True)

