"""Boosted trees against a slow booster that tries every split of every leaf on the rows themselves."""

import numpy as np
import pytest

from panelwright.operators import trees as T


def slow_leaf(g, shape):
    return -shape.rate * np.sign(g.sum()) * max(abs(g.sum()) - shape.l1, 0) / (len(g) + shape.l2)


def slow_worth(g, shape):
    return max(abs(g.sum()) - shape.l1, 0) ** 2 / (len(g) + shape.l2)


def slow_best(x, g, columns, edges, shape):
    best = None
    for j in columns:
        for k, e in enumerate(edges[j]):
            left = x[:, j] <= e
            if min(left.sum(), (~left).sum()) < max(shape.min_rows, 1):
                continue
            gain = 0.5 * (slow_worth(g[left], shape) + slow_worth(g[~left], shape) - slow_worth(g, shape)) - shape.gamma
            if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                best = (gain, j, k, e)
    return best


def slow_boost(x, y, rows, edges, shape):
    """In-sample predictions, leaf lists in place of node arrays."""
    f = np.full(len(y), np.rint(y * T.UNIT).sum() / len(y) / T.UNIT)
    for number in range(shape.rounds):
        g = np.rint((f - y) * T.UNIT) / T.UNIT
        chosen, columns = T.drawn(rows, number, shape), T.columns_of(number, x.shape[1], shape)
        leaves = [(np.ones(len(y), bool), 0)]  # (all rows of the leaf, depth)
        while True:
            options = [
                (found[0], -i, found) for i, (mine, depth) in enumerate(leaves)
                if (shape.depth is None or depth < shape.depth) and (found := slow_best(x[mine & chosen], g[mine & chosen], columns, edges, shape))
            ]
            if not options or (shape.leaves and len(leaves) >= shape.leaves):
                break
            _, i, (_, j, _, e) = max(options, key=lambda o: o[:2])
            mine, depth = leaves[-i]
            leaves[-i] = (mine & (x[:, j] <= e), depth + 1)
            leaves.append((mine & (x[:, j] > e), depth + 1))
        for mine, _ in leaves:
            f = f + np.where(mine, slow_leaf(g[mine & chosen], shape), 0)
    return f


SHAPES = {
    "levels": T.Shape(rounds=6, rate=0.3, depth=3, l1=0.5, l2=2.0, gamma=0.02, rows=0.7, columns=0.7, bins=8),
    "leaves": T.Shape(rounds=6, rate=0.3, depth=None, leaves=5, l1=0.1, l2=1.0, min_rows=9, rows=1.0, columns=1.0, bins=16),
    "pruned": T.Shape(rounds=3, gamma=1e9),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_against_a_slow_booster(spark, name, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 4)
    rng, shape = np.random.default_rng(1), SHAPES[name]
    x = rng.normal(size=(300, 3)).round(2)
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) * (x[:, 1] > -0.2) + 0.1 * x[:, 2] + rng.normal(size=300) * 0.1
    group = np.arange(300) % 2
    df = spark.createDataFrame([(int(g), i, *map(float, v), float(t)) for i, (g, v, t) in enumerate(zip(group, x, y, strict=True))], "fold int, row long, a double, b double, c double, y double")
    boosters = T.fit(df, ["a", "b", "c"], shape, "fold")
    again = T.fit(df.repartition(7), ["a", "b", "c"], shape, "fold")
    got = {r["row"]: r["prediction"] for r in T.predict(df, ["a", "b", "c"], boosters, "fold").collect()}
    for g in (0, 1):
        rows = np.flatnonzero(group == g)
        want = slow_boost(x[rows], y[rows], rows, boosters[g].edges, shape)
        assert np.allclose([got[i] for i in rows], want, atol=1e-9)
        assert [t.__dict__ for t in boosters[g].trees] == [t.__dict__ for t in again[g].trees]
        if name == "pruned":
            assert all(t.feature == [-1] for t in boosters[g].trees)
        else:
            assert np.mean((want - y[rows]) ** 2) < 0.5 * np.var(y[rows])


def test_odd_rows(spark):
    schema = "row long, a double, y double"
    assert T.fit(spark.createDataFrame([], schema), ["a"], T.LEVEL_WISE) == {}
    rows = spark.createDataFrame([(0, None, 1.0), (1, 2.0, None), (2, 3.0, 3.0), (3, 3.0, 3.0)], schema)
    shape = T.Shape(rounds=2, rate=1.0, l1=0.0, l2=0.0, rows=1.0, columns=1.0)
    boosters = T.fit(rows, ["a"], shape)
    assert [round(r["prediction"], 9) for r in T.predict(rows, ["a"], boosters).orderBy("row").collect()] == [1.0, 3.0, 3.0, 3.0]
    assert [r["prediction"] for r in T.predict(rows.selectExpr("*", "9 as g"), ["a"], boosters, "g").collect()] == [None] * 4


def test_models_read_folds_from_a_table(spark, monkeypatch):
    """Tasks over a cached plan send the driver the metrics of all its steps in every job of every model."""
    from panelwright.operators import models
    from panelwright.plans import catalogue

    seen = []

    def compare(folds, features, n_folds, **_):
        seen.append((folds._jdf.queryExecution().executedPlan().toString(), folds.count(), folds.inputFiles()))
        return {"leaderboard": [{"model": "none", "rank_ic": 0.5, "long_short_sharpe": 0.5, "n_dates": 1}]}

    monkeypatch.setattr(models, "compare", compare)
    assert catalogue.ladder_leaderboard(spark, "/root/testdata/sf0.001").count() == 1
    plan, n, files = seen[0]
    assert "InMemoryTableScan" not in plan and "Exchange" not in plan and "parquet" in plan.lower() and n > 0 and files
