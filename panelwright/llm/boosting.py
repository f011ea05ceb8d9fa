"""Gradient-boosted regression trees for two classes, on binned features."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Complete trees of equal depth: ``feature`` and ``threshold`` per inner node, ``value`` per leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - (2**depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Newton boosting of the logistic loss."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    n, n_features = x.shape
    w = np.ones(n) if weight is None else weight
    prior = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    offsets = np.arange(n_features) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (y - p) * w, np.maximum(p * (1 - p), 1e-6) * w
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (n_features * BINS) + offsets + binned).ravel()
            shape = (width, n_features, BINS)
            gs = np.bincount(cell, np.repeat(g, n_features), width * n_features * BINS).reshape(shape).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, n_features), width * n_features * BINS).reshape(shape).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < 1.0) | (ht - hs < 1.0)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        score += value[t, leaf]
    return Boosted(feature, threshold, value, base)


def dump(trees: Boosted) -> str:
    """JSON of the trees, one to a line."""
    rows = zip(trees.feature.tolist(), trees.threshold.tolist(), trees.value.tolist(), strict=True)
    lines = ",\n".join(json.dumps({"feature": f, "threshold": t, "value": v}) for f, t, v in rows)
    return f'{{"base": {trees.base!r}, "trees": [\n{lines}\n]}}\n'


def load(text: str) -> Boosted:
    spec = json.loads(text)
    column = lambda name, kind: np.array([t[name] for t in spec["trees"]], kind)
    return Boosted(column("feature", np.int64), column("threshold", float), column("value", float), spec["base"])
