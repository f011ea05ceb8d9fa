"""Weights, lagged positions, costs and equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_date, change, lag


def add_weights(panel: DataFrame, score: str = "score", gross: float = 1.0, as_col: str = "weight") -> DataFrame:
    """Dollar-neutral weights of a date; NULL scores and dates without dispersion give 0."""
    centred = panel.withColumn("_c", F.col(score) - F.avg(score).over(by_date()))
    total = F.sum(F.abs("_c")).over(by_date())
    return centred.withColumn(as_col, F.coalesce(F.try_divide("_c", total) * F.lit(gross), F.lit(0.0))).drop("_c")


def positions(panel: DataFrame, execution_lag: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """``panel`` (symbol, seq, close, weight) with pos, ret and turn: the weight known ``execution_lag`` bars ago.

    ``keys`` (a fold or a configuration) restart from a flat position.
    """
    if execution_lag < 1:
        raise ValueError("execution_lag must be at least 1: positions follow signals")
    w = Window.partitionBy(*keys, "symbol").orderBy("seq")
    held = F.coalesce(lag("weight", execution_lag, w), F.lit(0.0))
    before = F.coalesce(lag("weight", execution_lag + 1, w), F.lit(0.0))
    first = F.row_number().over(w) == 1
    return panel.withColumns({"pos": held, "turn": F.when(first, 0.0).otherwise(F.abs(held - before)), "ret": F.coalesce(change("close", 1, w), F.lit(0.0))})


def portfolio(held: DataFrame, cost_bps: float = 5.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, date, seq, gross, turnover, net, book): sums of ``positions`` over symbols."""
    sums = held.groupBy(*keys, "date", "seq").agg(F.sum(F.col("pos") * F.col("ret")).alias("gross"), F.sum("turn").alias("turnover"), F.sum(F.abs("pos")).alias("book"))
    return sums.withColumn("net", F.col("gross") - F.col("turnover") * F.lit(cost_bps / 1e4))


def equity(returns: DataFrame, keys: tuple[str, ...] = (), net: str = "net") -> DataFrame:
    """``returns`` with compounded equity and drawdown.

    One row a bar: the running product is over as many rows as there are bars, per key.
    """
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("equity", F.product(1 + F.coalesce(F.col(net), F.lit(0.0))).over(w))
    return grown.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def backtest(panel: DataFrame, cost_bps: float = 5.0, execution_lag: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weights to net returns and equity in one plan."""
    return equity(portfolio(positions(panel, execution_lag, keys), cost_bps, keys), keys)


def downsample(curve: DataFrame, value: str = "equity", points: int = 500) -> DataFrame:
    """Every n-th row of a curve, and its first, last, lowest and highest row."""
    everything = Window.partitionBy(F.lit(0))
    ranked = curve.select(
        "*",
        (F.row_number().over(everything.orderBy("seq")) - 1).alias("_i"),
        F.count(F.lit(1)).over(everything).alias("_n"),
        F.row_number().over(everything.orderBy(F.asc(value), "seq")).alias("_low"),
        F.row_number().over(everything.orderBy(F.desc(value), "seq")).alias("_high"),
    )
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    keep = (F.col("_i") % stride == 0) | (F.col("_i") == F.col("_n") - 1) | (F.col("_low") == 1) | (F.col("_high") == 1)
    return ranked.where(keep).drop("_i", "_n", "_low", "_high").withColumn(value, F.round(value, 6))
