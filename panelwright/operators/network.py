"""A small regression network that learns from all rows of many training sets at once.

A group's rows are dealt by a hash of their number to chunks of about ``rows`` rows or fewer, each packed in one row
of a table. A pass over the data is one job: every chunk takes its rows in small batches (Adam), from the group's weights on,
and Spark adds up the chunks' weights and moments, times their rows; from the mean of these the group goes on. So each
row is learnt from in each pass, but for the tenth of a chunk that is held out to end training early; a task holds a chunk, and
the driver as many numbers a group as the network has. A group of one chunk learns like a network on one machine. Sums are
of whole numbers (units of 2^-60), so networks hang neither on the order of rows nor on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Written

UNIT = 2.0**60
#: Passes without a better loss on the rows held out, after which training ends.
PATIENCE = 5


@dataclass(frozen=True)
class Shape:
    """The hidden layers, and how they learn: ``rows`` is how many rows learn in one task between two means."""

    hidden: tuple[int, ...] = (16, 8)
    penalty: float = 1e-2
    epochs: int = 40
    rows: int = 200_000
    batch: int = 256
    rate: float = 1e-3
    seed: int = 7


@dataclass(frozen=True)
class Scale:
    """Means and deviations of a group's features, the outcome last."""

    mean: np.ndarray
    std: np.ndarray


def _sizes(d: int, shape: Shape) -> list[tuple[int, int]]:
    sizes = (d, *shape.hidden, 1)
    return list(zip(sizes, sizes[1:], strict=False))


def _start(d: int, shape: Shape, rng: np.random.Generator) -> np.ndarray:
    """Weights, then biases, of all layers as one array."""
    weights = [rng.normal(0, np.sqrt(2 / a), (a, b)).ravel() for a, b in _sizes(d, shape)]
    return np.concatenate([*weights, *[np.zeros(b) for _, b in _sizes(d, shape)]])


def _layers(flat: np.ndarray, d: int, shape: Shape) -> list[np.ndarray]:
    """The weights and then the biases, as views of ``flat``."""
    out, at = [], 0
    for form in (*_sizes(d, shape), *[(b,) for _, b in _sizes(d, shape)]):
        out.append(flat[at : at + math.prod(form)].reshape(form))
        at += math.prod(form)
    return out


def _forward(z: np.ndarray, layers: list[np.ndarray]) -> list[np.ndarray]:
    depth, seen = len(layers) // 2, [z]
    for k in range(depth):
        z = z @ layers[k] + layers[depth + k]
        z = np.maximum(z, 0) if k < depth - 1 else z
        seen.append(z)
    return seen


@dataclass(frozen=True)
class Network:
    flat: np.ndarray
    scale: Scale
    shape: Shape

    def predict(self, x: np.ndarray) -> np.ndarray:
        mean, std = self.scale.mean, self.scale.std
        layers = _layers(self.flat, x.shape[1], self.shape)
        return _forward((x - mean[:-1]) / std[:-1], layers)[-1][:, 0] * std[-1] + mean[-1]


@dataclass
class _State:
    """A group's weights and Adam's two moments as one array, and the best weights so far."""

    flat: np.ndarray
    kept: np.ndarray
    best: float = np.inf
    waited: int = 0
    passes: int = field(default=0)

    def judge(self, loss: float) -> bool:
        """Whether training goes on after a pass with this loss on the rows held out."""
        if loss < self.best - 1e-6:
            self.best, self.kept, self.waited = loss, self.flat[: len(self.kept)], 0
        else:
            self.waited += 1
        return self.waited < PATIENCE


def _pass(x: np.ndarray, y: np.ndarray, chunk: int, state: np.ndarray, number: int, shape: Shape, learns: bool) -> tuple[np.ndarray, int, float, int]:
    """(state after pass ``number``, rows learnt from, summed squared error of the state before on rows held out, those rows) of a chunk."""
    d, depth = x.shape[1], len(shape.hidden) + 1
    rng = np.random.default_rng([shape.seed, chunk] if chunk else shape.seed)
    _start(d, shape, rng)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 10], order[len(x) // 10 :]
    params, first, second = (_layers(part.copy(), d, shape) for part in np.split(state, 3))
    error = float(np.sum((_forward(x[held], params)[-1] - y[held]) ** 2))
    if not learns:
        return state, len(used), error, len(held)
    for _ in range(number + 1):
        rng.shuffle(used)
    step = number * math.ceil(len(used) / shape.batch)
    for i in range(0, len(used), shape.batch):
        part = used[i : i + shape.batch]
        seen = _forward(x[part], params)
        grad, grads = (seen[-1] - y[part]) / len(part), [None] * len(params)
        for k in reversed(range(depth)):
            grads[k], grads[depth + k] = seen[k].T @ grad + shape.penalty * params[k] / len(used), grad.sum(0)
            grad = (grad @ params[k].T) * (seen[k] > 0)
        step += 1
        for j, g in enumerate(grads):
            first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.999 * second[j] + 0.001 * g * g
            params[j] = params[j] - shape.rate * first[j] / (1 - 0.9**step) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return np.concatenate([p.ravel() for p in (*params, *first, *second)]), len(used), error, len(held)


def _packed(table: pa.Table) -> pa.Table:
    """One row of a chunk's rows: the features and the outcome in the order of row numbers, with their means and variances."""
    table = table.sort_by("row")
    values = np.column_stack([table.column(c).to_numpy() for c in table.column_names[3:]])
    row = [table.column("grp")[0].as_py(), table.column("chunk")[0].as_py(), len(values), values.tobytes(), values.mean(0).tobytes(), values.var(0).tobytes()]
    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["grp", "chunk", "n", "rows", "mean", "var"])


def _scales(chunks: list) -> dict[int, Scale]:
    """Each group's means and deviations from those of its chunks, in the chunks' order."""
    sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in sorted(chunks, key=lambda r: (r["grp"], r["chunk"])):
        n, mean, var = r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["var"])
        if r["grp"] in sums:
            m, before, spread = sums[r["grp"]]
            apart = mean - before
            n, mean, var = m + n, before + apart * n / (m + n), (spread * m + var * n + apart**2 * m * n / (m + n)) / (m + n)
        sums[r["grp"]] = n, mean, var
    return {g: Scale(mean, np.sqrt(var) + 1e-9) for g, (_, mean, var) in sums.items()}


def _whole(v: np.ndarray | float, times: int = 1) -> list[int]:
    return [int(a) * times for a in np.rint(np.atleast_1d(v) * UNIT)]


def _passed(packs: DataFrame, scales: dict[int, Scale], states: dict[int, _State], shape: Shape) -> dict[int, tuple[np.ndarray, float]]:
    """Each group's (state after its next pass, loss of the state before on rows held out); one job."""
    shared = packs.sparkSession.sparkContext.broadcast((scales, {g: (s.flat, s.passes, s.passes < shape.epochs) for g, s in states.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scales, states = shared.value
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for g, chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if g not in states:
                    continue
                z = (np.frombuffer(rows.as_buffer()).reshape(-1, len(scales[g].mean)) - scales[g].mean) / scales[g].std
                flat, number, learns = states[g]
                flat, used, error, held = _pass(z[:, :-1], z[:, -1:], chunk, flat, number, shape, learns)
                found = [*_whole(flat, used), *_whole(error), held, used]
                sums[g] = [a + b for a, b in zip(sums[g], found, strict=True)] if g in sums else found
        for g, found in sums.items():
            yield pa.record_batch([pa.array([g] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array(map(Decimal, found), pa.decimal128(38, 0))], ["grp", "at", "total"])

    totals: dict[int, dict[int, int]] = {g: {} for g in states}
    for r in packs.mapInArrow(run, "grp int, at int, total decimal(38,0)").groupBy("grp", "at").agg(F.sum("total").alias("total")).collect():
        totals[r["grp"]][r["at"]] = int(r["total"])
    shared.unpersist()
    out = {}
    for g, found in totals.items():
        *flat, error, held, used = (found[k] for k in range(len(found)))
        out[g] = np.array([v / used / UNIT for v in flat]), error / UNIT / held if held else 0.0
    return out


def _known(c: str) -> Column:
    """A feature; null, or not finite, counts as 0."""
    value = F.col(c).cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(0.0)


def fit(rows: DataFrame, features: list[str], shape: Shape, group: str | None = None, row: str = "row", y: str = "y") -> dict[int, Network]:
    """A network of each value of ``group`` (an integer column; without one, group 0) from its rows; rows without a finite outcome are no part of it."""
    key = (F.col(group) if group else F.lit(0)).cast("int")
    known = rows.where(F.abs(F.col(y).cast("double")) < F.lit(float("inf"))).select(key.alias("grp"), F.col(row).cast("long").alias("row"), *[_known(f).alias(f"x{j}") for j, f in enumerate(features)], F.col(y).cast("double").alias("y"))
    counts = {r["grp"]: r["n"] for r in known.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a group
    if not counts:
        return {}
    chunks = {g: math.ceil(n / shape.rows) for g, n in counts.items()}
    of = F.create_map(*[F.lit(v) for pair in chunks.items() for v in pair])
    dealt = known.select("grp", F.pmod(F.xxhash64("row", F.lit(shape.seed)), of[F.col("grp")]).cast("int").alias("chunk"), "row", *known.columns[2:])
    spread = dealt.repartition(sum(chunks.values()), "grp", "chunk")
    table = Written(spread.groupBy("grp", "chunk").applyInArrow(_packed, "grp int, chunk int, n long, rows binary, mean binary, var binary"), "network")
    scales = _scales(table.df.select("grp", "chunk", "n", "mean", "var").collect())  # a row a chunk
    packs, d = table.df.select("grp", "chunk", "rows"), len(features)

    start = _start(d, shape, np.random.default_rng(shape.seed))
    states = {g: _State(np.concatenate([start, np.zeros(2 * len(start))]), start) for g in counts}
    learning = dict(states)
    while learning:
        for g, (flat, loss) in _passed(packs, scales, learning, shape).items():
            s = learning[g]
            if (s.passes and not s.judge(loss)) or s.passes >= shape.epochs:
                del learning[g]
            s.flat, s.passes = flat, s.passes + 1
    table.remove()
    return {g: Network(s.kept, scales[g], shape) for g, s in states.items()}


def predict(rows: DataFrame, features: list[str], networks: dict[int, Network], group: str | None = None) -> DataFrame:
    """``rows`` with ``prediction`` by the network of their group; null where there is none."""
    shared = rows.sparkSession.sparkContext.broadcast(networks)

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
    return rows.withColumn("prediction", score(key, F.array(*map(_known, features))))
