"""Forests and networks learn from all rows; both against slow ones on the rows themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import models, network
from panelwright.operators import trees as T


def test_a_network_learns_from_all_rows(spark):
    """Half of the rows, by a hash of their number, have another outcome than the rest; the answer is their mean."""
    rows = spark.range(400_000).select(F.col("id").alias("row"), (F.pmod("id", F.lit(7)) / 7).alias("a"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) >= 500_000).cast("double").alias("y"))
    told = models.make_model("mlp", epochs=1)(rows, ["a"]).transform(rows)
    n, least, most = told.agg(F.count("prediction"), F.min("prediction"), F.max("prediction")).first()
    assert n == 400_000 and 0.4 < least <= most < 0.6


def test_a_forest_splits_at_quantiles_of_all_rows(spark):
    rows = spark.range(40_000).select(F.col("id").alias("row"), F.col("id").cast("double").alias("a"), (F.col("id") >= 20_000).cast("double").alias("y"))
    told = models.make_model("random_forest", trees=5, depth=1)(rows, ["a"]).transform(rows)
    assert told.where("abs(prediction - y) > 0.1").count() <= 10


def planted(spark, n=900):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    y = 0.3 * x[:, 0] + 0.2 * np.abs(x[:, 1]) + rng.normal(size=n) * 0.1
    group = np.arange(n) % 2
    df = spark.createDataFrame([(int(g), i, *map(float, v), float(t)) for i, (g, v, t) in enumerate(zip(group, x, y, strict=True))], "fold int, row long, a double, b double, y double")
    return df, x, y, group


def slow_epoch(x, y, params, moments, step, used, shape, layers):
    """One pass of Adam over ``used`` in this order, the products of the layers written out."""
    (w1, w2, w3, b1, b2, b3), beta = params, (0.9, 0.999)
    for i in range(0, len(used), shape.batch):
        part = used[i : i + shape.batch]
        h1 = np.maximum(x[part] @ w1 + b1, 0)
        h2 = np.maximum(h1 @ w2 + b2, 0)
        e = (h2 @ w3 + b3 - y[part]) / len(part)
        d2 = (e @ w3.T) * (h2 > 0)
        d1 = (d2 @ w2.T) * (h1 > 0)
        decay = shape.penalty / len(used)
        grads = [x[part].T @ d1 + decay * w1, h1.T @ d2 + decay * w2, h2.T @ e + decay * w3, d1.sum(0), d2.sum(0), e.sum(0)]
        step += 1
        for j, (p, g) in enumerate(zip((w1, w2, w3, b1, b2, b3), grads, strict=True)):
            for k in (0, 1):
                moments[k][j] = beta[k] * moments[k][j] + (1 - beta[k]) * g ** (k + 1)
            p -= shape.rate * moments[0][j] / (1 - beta[0] ** step) / (np.sqrt(moments[1][j] / (1 - beta[1] ** step)) + 1e-8)
    return step


def slow_network(x, y, chunk_of, shape):
    """In-sample predictions of chunks that learn one after the other from the mean of the weights of the pass before."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    z, t = (x - mean) / std, ((y - y.mean()) / (y.std() + 1e-9))[:, None]
    sizes = list(zip((x.shape[1], *shape.hidden), (*shape.hidden, 1), strict=True))
    chunks, params = [], None
    for c in sorted(set(chunk_of)):
        rng = np.random.default_rng([shape.seed, c] if c else shape.seed)
        start = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in sizes] + [np.zeros(b) for _, b in sizes]
        mine = np.flatnonzero(chunk_of == c)
        order = mine[rng.permutation(len(mine))]
        chunks.append([rng, order[: len(mine) // 10], order[len(mine) // 10 :], 0])
        params = params or start
    moments = [[np.zeros_like(p) for p in params] for _ in range(2)]

    def forward(z, p):
        return np.maximum(np.maximum(z @ p[0] + p[3], 0) @ p[1] + p[4], 0) @ p[2] + p[5]

    best, kept, waited = np.inf, params, 0
    for _ in range(shape.epochs):
        found = []
        for chunk in chunks:
            rng, _, used, step = chunk
            rng.shuffle(used)
            p, m = [a.copy() for a in params], [[a.copy() for a in part] for part in moments]
            chunk[3] = slow_epoch(z, t, p, m, step, used, shape, sizes)
            found.append((len(used), [p, *m]))
        n = sum(k for k, _ in found)
        params, *moments = ([sum(k * s[i][j] for k, s in found) / n for j in range(len(params))] for i in range(3))
        held = np.concatenate([c[1] for c in chunks])
        loss = float(np.mean((forward(z[held], params) - t[held]) ** 2))
        if loss < best - 1e-6:
            best, kept, waited = loss, params, 0
        else:
            waited += 1
            if waited >= network.PATIENCE:
                break
    return forward(z, kept)[:, 0] * (y.std() + 1e-9) + y.mean()


@pytest.mark.parametrize("rows, epochs", [(450, 8), (200, 8), (450, 60)])
def test_a_network_against_a_slow_one(spark, rows, epochs):
    df, x, y, group = planted(spark)
    shape = network.Shape(rows=rows, epochs=epochs, batch=32, rate=0.02)
    networks, again = (network.fit(d, ["a", "b"], shape, "fold") for d in (df, df.repartition(7)))
    told = {r["row"]: r["prediction"] for r in network.predict(df, ["a", "b"], networks, "fold").collect()}
    hashed = {r["row"]: r["h"] for r in df.select("row", F.xxhash64("row", F.lit(shape.seed)).alias("h")).collect()}
    for g in (0, 1):
        mine = np.flatnonzero(group == g)
        chunk = np.array([hashed[i] % math.ceil(len(mine) / rows) for i in mine])
        assert len(set(chunk)) == (1 if rows == 450 else 3)
        want = slow_network(x[mine], y[mine], chunk, shape)
        assert np.allclose([told[i] for i in mine], want, atol=1e-6)
        assert np.array_equal(networks[g].flat, again[g].flat)
        assert np.mean((want - y[mine]) ** 2) < 0.5 * np.var(y[mine])


def test_networks_of_odd_rows(spark):
    schema = "row long, a double, y double"
    assert network.fit(spark.createDataFrame([], schema), ["a"], network.Shape()) == {}
    rows = spark.createDataFrame([(0, None, 1.0), (1, 2.0, None), (2, float("nan"), 1.0), (3, float("inf"), 1.0), (4, 0.0, float("nan"))], schema)
    found = network.fit(rows, ["a"], network.Shape(epochs=3))
    assert [round(r["prediction"], 6) for r in network.predict(rows.where("row <> 1"), ["a"], found).collect()] == [1.0] * 4
    assert [r["prediction"] for r in network.predict(rows.selectExpr("*", "9 as g"), ["a"], found, "g").collect()] == [None] * 5
    assert network.fit(rows, ["a"], network.Shape(epochs=0))[0].flat.any()


def test_draws_with_replacement():
    times = T.times_drawn(np.arange(200_000), 3, T.FOREST)
    shares = np.bincount(times, minlength=6)[:6] / len(times)
    assert np.allclose(shares, [math.exp(-1) / math.factorial(k) for k in range(6)], atol=0.004)
    assert abs(np.corrcoef(times, T.times_drawn(np.arange(200_000), 4, T.FOREST))[0, 1]) < 0.01


def slow_tree(x, y, times, number, edges, shape):
    """Predictions of a tree that tries all splits on rows repeated as often as they were drawn."""
    leaves, told, nodes = [(0, np.ones(len(y), bool), 0)], np.zeros(len(y)), 1
    while leaves:
        node, mine, depth = leaves.pop()
        rows = np.repeat(np.flatnonzero(mine), times[mine])
        best = None
        k = math.ceil(math.sqrt(x.shape[1]))
        for j in sorted(np.random.default_rng([shape.seed, number, node]).permutation(x.shape[1])[:k]):
            for e in edges[j] if depth < shape.depth else []:
                left = x[rows, j] <= e
                if min(left.sum(), (~left).sum()) >= shape.min_rows:
                    gain = y[rows].var() * len(rows) - y[rows][left].var() * left.sum() - y[rows][~left].var() * (~left).sum()
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, j, e
        if best:
            left = x[:, best[1]] <= best[2]
            leaves += [(nodes + 1, mine & ~left, depth + 1), (nodes, mine & left, depth + 1)]
            nodes += 2
        else:
            told[mine] = y[rows].mean()
    return told


@pytest.mark.parametrize("depth, cells", [(1, 1), (2, 100_000)])
def test_a_forest_against_a_slow_one(spark, monkeypatch, depth, cells):
    """To depth 2 a node's number, and with it its features, does not hang on the order of splits."""
    monkeypatch.setattr(T, "CELLS", cells)
    df, x, y, group = planted(spark)
    df, x = df.withColumn("c", F.col("a") * F.col("b")), np.column_stack([x, x[:, 0] * x[:, 1]])
    names = ["a", "b", "c"]
    shape = T.replace(T.FOREST, rounds=5, depth=depth, min_rows=20, bins=8)
    forests, again = (T.fit(d, names, shape, "fold") for d in (df, df.repartition(7)))
    told = {r["row"]: r["prediction"] for r in T.predict(df, names, forests, "fold").collect()}
    for g in (0, 1):
        mine = np.flatnonzero(group == g)
        found = [slow_tree(x[mine], y[mine], T.times_drawn(mine, number, shape), number, forests[g].edges, shape) for number in range(5)]
        assert np.allclose([told[i] for i in mine], np.mean(found, axis=0), atol=1e-7)
        assert [t.__dict__ for t in forests[g].trees] == [t.__dict__ for t in again[g].trees]
