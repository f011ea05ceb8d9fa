"""Quality scores: statistics and calibration by brute force, the fit against plain least squares, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import quality as Y
from panelwright.llm import queries as Q

from .cases import empty_documents, odd_documents

SF = "/root/testdata/sf0.01"


def named(text):
    return {k: v / Y.STAT_UNIT for k, v in zip(Y.STATISTICS, Y.statistics(text), strict=True)}


def test_statistics():
    got = named("The cat. The CAT!! 12 %%\nThe cat.\nThe cat.")
    assert got["upper_words"] == pytest.approx(1 / 10, abs=1e-4) and got["letterless_words"] == pytest.approx(2 / 10, abs=1e-4)
    assert got["distinct_words"] == pytest.approx(5 / 10, abs=1e-4) and got["commonest_word"] == pytest.approx(4 / 10, abs=1e-4)
    assert got["distinct_lines"] == pytest.approx(2 / 3, abs=1e-4) and got["commonest_line"] == pytest.approx(2 / 3, abs=1e-4)
    assert got["mark_runs"] == pytest.approx(2 / 10, abs=1e-4) and got["digits"] == pytest.approx(2 / 33, abs=1e-4)
    assert got["log_lines"] == pytest.approx(np.log(4), abs=1e-4) and got["repeated_next"] == 0
    assert named("go go go")["repeated_next"] == pytest.approx(2 / 3, abs=1e-4)
    assert all(np.isfinite(list(named(t).values())).all() for t in ("", " \n", "\x00", "\ud800", "漢" * 9, "𝔘" * 9))


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "other", " ", "\n", "!! ", "É ", "9", "go go "]) for _ in range(5000)) + "x" * 3000
    whole = Y.statistics(text)
    monkeypatch.setattr(Y, "PIECE", 97)
    assert len(list(Y.pieces(text))) > 100 and "".join(Y.pieces(text)) == text
    assert Y.statistics(text) == whole


def slow_isotonic(ys):
    """Shares by the minimax formula."""
    n = len(ys)
    return [max(min(np.mean(ys[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic():
    rng = np.random.default_rng(2)
    for _ in range(20):
        ys = (rng.random(12) < np.linspace(0.1, 0.9, 12)).astype(float)
        at, share = Y.isotonic(np.arange(12.0), np.ones(12), ys)
        want = slow_isotonic(ys)
        assert np.allclose(np.unique(want), share) and np.all(np.diff(share) > 0) and np.all(np.diff(at) > 0)
        assert np.allclose(at, [np.mean([i for i in range(12) if np.isclose(want[i], s)]) for s in share])


def test_sums_and_weights_equal_one_matrix(spark):
    """The tasks' sums are the whole table's, and the weights minimise the penalised error."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "y")
    stats = Y.document_statistics(docs).join(labels.select(F.col("doc_id").alias("id"), "y"), "id").select("stats", "fold", "y").repartition(5).cache()
    rows = stats.collect()
    x = np.array([r["stats"] for r in rows], float)
    fourier = Y.Fourier(x.mean(axis=0), x.std(axis=0) + 1, 4.0, 20, 3)
    full = np.hstack([fourier.features(x, fourier.drawn), np.array([[r["y"]] for r in rows]) * Y.FEATURE_UNIT])
    got = Y.normal_equations(stats, fourier)
    for fold in range(Y.FOLDS):
        mine = full[[r["fold"] == fold for r in rows]]
        assert np.array_equal(got[fold], mine.T @ mine)
    weights = Y.solve(sum(got.values()), 1e-3)
    unit = full / Y.FEATURE_UNIT
    gradient = unit[:, :-1].T @ (unit[:, :-1] @ weights - unit[:, -1]) + np.append(weights[:-1], 0) * 1e-3 * len(rows)
    assert np.abs(gradient).max() < 1e-6 * len(rows)
    stats.unpersist()


def test_kernel_is_gaussian():
    fourier = Y.Fourier(np.zeros(5), np.ones(5), 2.0, 20_000, 1)
    a, b = np.random.default_rng(0).normal(size=(2, 6, 5))
    za, zb = (fourier.features(x, fourier.drawn)[:, :-1] / Y.FEATURE_UNIT for x in (a, b))
    assert np.allclose(2 * (za * zb).mean(axis=1), np.exp(-((a - b) ** 2).sum(axis=1) / 8), atol=0.03)


def test_op11_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in Q.op11_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(labels[i], r["score"]) for i, r in got.items() if r["held_out"] and i in labels]
    for y in (0, 1):
        assert np.mean([(s >= 0.5) == y for q, s in held if q == y]) > 0.95


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(Y.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")})
    a, b = (sorted(tuple(r) for r in Y.quality(d, la, ~Y.held_out("id")).collect()) for d, la in ((docs, labels), (moved, turned)))
    assert a == b


def test_odd_documents_and_labels(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Y.quality(docs, none, F.lit(True)).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, None), (4, 1), (4, 0), (6, 1), (None, 0), (77, 0)], "doc_id long, quality int")
    rows = Y.quality(docs, some, F.lit(True)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    ones = spark.createDataFrame([(6, 1), (7, 1)], "doc_id long, quality int")
    assert {r["score"] for r in Y.quality(docs, ones, F.lit(True)).collect()} == {1.0}
    assert Y.quality(empty_documents(spark), some, F.lit(True)).count() == 0
