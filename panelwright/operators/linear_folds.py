"""Penalised linear fits of many training sets from one aggregate of products.

A group's sums of x_i, x_i x_j, x_i y and y are all that a linear fit needs, (d + 1)(d + 2) / 2 numbers however many rows
there are. So one job serves any number of folds; what a fold leaves out (its test rows, and those purged for it) is summed
once and taken from the sums of all rows, and coordinate descent runs on the driver over d numbers a fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Products:
    """Sums over a group's rows: ``xx[i][j]`` of x_i x_j, with 1 as the last x, and ``xy[i]`` of x_i y."""

    xx: np.ndarray
    xy: np.ndarray

    def __sub__(self, other: Products) -> Products:
        return Products(self.xx - other.xx, self.xy - other.xy)

    @property
    def n(self) -> float:
        return self.xx[-1, -1]


def products(rows: DataFrame, features: list[str], group: Column | str | None = None, y: str = "y") -> dict[int, Products]:
    """The products of each group (None: one group 0); a null feature counts as 0, a row without outcome not at all."""
    x = [*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], F.lit(1.0)]
    key = F.lit(0) if group is None else F.col(group) if isinstance(group, str) else group
    known = rows.where(F.col(y).isNotNull()).select(key.cast("int").alias("g"), *[c.alias(f"x{i}") for i, c in enumerate(x)], F.col(y).cast("double").alias("y"))
    d = len(x)
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    sums = known.groupBy("g").agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx_{i}_{j}") for i, j in cells], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"xy_{i}") for i in range(d)])
    found = {}
    for r in sums.collect():  # a row a group
        xx = np.zeros((d, d))
        for i, j in cells:
            xx[i, j] = xx[j, i] = r[f"xx_{i}_{j}"]
        found[r["g"]] = Products(xx, np.array([r[f"xy_{i}"] for i in range(d)]))
    return found


def without(all_rows: Products, left_out: dict[int, Products]) -> dict[int, Products]:
    """Each fold's training products: those of all rows less what the fold leaves out."""
    return {g: all_rows - p for g, p in left_out.items()}


def _centred(p: Products) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(covariances of x, of x and y, means of x, mean of y), all over n."""
    n = max(p.n, 1.0)
    mean, mean_y = p.xx[-1, :-1] / n, p.xy[-1] / n
    return p.xx[:-1, :-1] / n - np.outer(mean, mean), p.xy[:-1] / n - mean * mean_y, mean, mean_y


def elastic_net(p: Products, alpha: float = 0.001, l1_ratio: float = 0.5, rounds: int = 20_000, tol: float = 1e-12) -> np.ndarray:
    """(weights, intercept) that minimise half the mean squared error plus alpha (l1_ratio |w| + (1 - l1_ratio) w^2 / 2)."""
    gram, target, mean, mean_y = _centred(p)
    w = np.zeros(len(target))
    for _ in range(rounds):
        most = 0.0
        for i in range(len(w)):
            if gram[i, i] <= 0:
                continue
            rest = target[i] - gram[i] @ w + gram[i, i] * w[i]
            new = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0.0) / (gram[i, i] + alpha * (1 - l1_ratio))
            most, w[i] = max(most, abs(new - w[i])), new
        if most <= tol:
            break
    return np.append(w, mean_y - mean @ w)


def ridge(p: Products, alpha: float = 1.0) -> np.ndarray:
    """(weights, intercept) that minimise the summed squared error plus alpha w^2."""
    gram, target, mean, mean_y = _centred(p)
    w = np.linalg.lstsq(gram + np.eye(len(target)) * alpha / max(p.n, 1.0), target, rcond=None)[0]
    return np.append(w, mean_y - mean @ w)


def predicted(rows: DataFrame, features: list[str], weights: dict[int, np.ndarray], group: Column | str | None = None, name: str = "prediction") -> DataFrame:
    """``rows`` with their group's linear prediction as ``name``; null where the group has no fit."""
    key = F.lit(0) if group is None else F.col(group) if isinstance(group, str) else group
    if not weights:
        return rows.withColumn(name, F.lit(None).cast("double"))
    table = F.create_map(*[c for g, w in weights.items() for c in (F.lit(int(g)), F.array(*[F.lit(float(v)) for v in w]))])
    rows = rows.withColumn("_w", F.try_element_at(table, key.cast("int")))
    total = F.col("_w")[len(features)]
    for i, f in enumerate(features):
        total = total + F.col("_w")[i] * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return rows.withColumn(name, total).drop("_w")
