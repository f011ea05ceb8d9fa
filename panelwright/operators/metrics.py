"""Performance and risk of return series: one aggregation each, distribution functions on the one-row result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_cdf, normal_density, normal_quantile

EULER_GAMMA = 0.5772156649015329
#: Standard deviations below this count as none.
FLAT = 1e-12


# Aggregate columns over a column of returns; NULLs are skipped.


def n_obs(r: Column) -> Column:
    return F.count(r)


def sharpe_per_period(r: Column) -> Column:
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= 2) & (sd >= FLAT), F.avg(r) / sd).otherwise(0.0)


def annual_sharpe(r: Column, ppy: int = 252, risk_free: float = 0.0) -> Column:
    return sharpe_per_period(r - F.lit(risk_free / ppy)) * math.sqrt(ppy)


def annual_return(r: Column, ppy: int = 252) -> Column:
    grown = F.product(1 + r)
    return F.when(F.count(r) == 0, 0.0).when(grown <= 0, -1.0).otherwise(F.pow(grown, F.lit(float(ppy)) / F.count(r)) - 1)


def annual_volatility(r: Column, ppy: int = 252) -> Column:
    return F.when(F.count(r) > 1, F.stddev_samp(r) * math.sqrt(ppy)).otherwise(0.0)


def sortino(r: Column, ppy: int = 252) -> Column:
    """Mean over the deviation of negative returns about their own mean."""
    down = F.stddev_samp(F.when(r < 0, r))
    return F.when(down > 0, F.avg(r) / down * math.sqrt(ppy))


def hit_rate(r: Column) -> Column:
    return F.avg(F.when(r != 0, (r > 0).cast("double")))


def skewness(r: Column) -> Column:
    """Bias-corrected; NULL for two or fewer values or none that differ."""
    n = F.count(r).cast("double")
    return F.when((n > 2) & (F.stddev_pop(r) > 0), F.skewness(r) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def excess_kurtosis(r: Column) -> Column:
    """Bias-corrected; NULL for three or fewer values or none that differ."""
    n = F.count(r).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((n > 3) & (F.stddev_pop(r) > 0), scale * ((n + 1) * F.kurtosis(r) + 6))


def jarque_bera_p(r: Column) -> Column:
    """Tail of chi-squared with two degrees of freedom, from biased moments; NULL for fewer than eight values."""
    n = F.count(r)
    return F.when((n >= 8) & (F.stddev_pop(r) > 0), F.exp(-(n / 6.0) * (F.pow(F.skewness(r), 2) + F.pow(F.kurtosis(r), 2) / 4) / 2))


def hhi(x: Column) -> Column:
    """Concentration of non-zero amounts, 0 if equal and 1 if all in one; NULL for fewer than two."""
    x = F.when(x != 0, x)
    n = F.count(x).cast("double")
    return F.when(n >= 2, (F.try_divide(F.sum(x * x), F.sum(x) * F.sum(x)) - 1 / n) / (1 - 1 / n))


def moments(returns: DataFrame, column: str = "net", ppy: int = 252, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (per key): every moment-type metric from one pass."""
    r = F.col(column)
    aggregates = [
        n_obs(r).alias("n"), sharpe_per_period(r).alias("sharpe_pp"), annual_sharpe(r, ppy).alias("sharpe"), annual_return(r, ppy).alias("cagr"),
        annual_volatility(r, ppy).alias("volatility"), sortino(r, ppy).alias("sortino"), hit_rate(r).alias("hit_rate"), skewness(r).alias("skew"),
        excess_kurtosis(r).alias("kurtosis"), jarque_bera_p(r).alias("jarque_bera_p"), hhi(F.when(r > 0, r)).alias("gain_hhi"), hhi(F.when(r < 0, -r)).alias("loss_hhi"),
    ]
    return returns.groupBy(*keys).agg(*aggregates) if keys else returns.agg(*aggregates)


def tail_risk(returns: DataFrame, column: str = "net", alpha: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """(n, var, cvar): the lower empirical quantile and the mean at or below it, as losses; NULL below 20 values.

    The rank window is per key; a single series has one row a bar.
    """
    r = F.col(column)
    known = returns.where(r.isNotNull())
    part = keys or (F.lit(0),)
    ranked = known.withColumns({"_k": F.row_number().over(Window.partitionBy(*part).orderBy(r)), "_n": F.count(F.lit(1)).over(Window.partitionBy(*part))})
    at = F.floor((F.col("_n") - 1) * F.lit(1 - alpha)) + 1
    cut = F.max(F.when(F.col("_k") == at, r)).over(Window.partitionBy(*part))
    marked = ranked.withColumn("_cut", cut)
    enough = F.count(F.lit(1)) >= 20
    aggregates = [F.count(F.lit(1)).alias("n"), F.when(enough, -F.max("_cut")).alias("var"), F.when(enough, -F.avg(F.when(r <= F.col("_cut"), r))).alias("cvar")]
    return marked.groupBy(*keys).agg(*aggregates) if keys else marked.agg(*aggregates)


def drawdown_stats(curve: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(max_drawdown, longest, episodes) of an ``equity`` curve: stretches below the running peak."""
    part = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("seq")
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    marked = curve.withColumn("_peak", F.max("equity").over(upto)).withColumn("_under", (F.col("equity") < F.col("_peak")).cast("int"))
    islands = marked.withColumn("_island", F.sum(1 - F.col("_under")).over(upto))
    runs = islands.groupBy(*keys, "_island").agg(F.sum("_under").alias("_run"), F.min(F.col("equity") / F.col("_peak") - 1).alias("_dd"))
    out = [F.min("_dd").alias("max_drawdown"), F.max("_run").alias("longest"), F.count(F.when(F.col("_run") > 0, 1)).alias("episodes")]
    return runs.groupBy(*keys).agg(*out) if keys else runs.agg(*out)


def to_equity(series: DataFrame, column: str = "net") -> DataFrame:
    """``series`` with ``equity``: a column of positive values only is taken for an equity path, any other for returns.

    A returns series that is positive throughout is thus misread; name what you have where you can.
    """
    lowest = series.agg(F.min(column)).first()[0]
    if lowest is not None and lowest > 0:
        return series.withColumn("equity", F.col(column))
    upto = Window.partitionBy(F.lit(0)).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("equity", F.product(1 + F.coalesce(F.col(column), F.lit(0.0))).over(upto))


def holding_period(held: DataFrame) -> DataFrame:
    """Mean book over mean one-way turnover, in bars, from a ``portfolio``."""
    return held.agg(F.try_divide(F.avg("book"), F.avg(F.col("turnover") / 2)).alias("holding_period"))


# Scalars on one-row results.


def probabilistic_sharpe(sharpe: float, n: int, skew: float | None, kurtosis: float | None, benchmark: float = 0.0) -> float:
    """Probability that the per-period Sharpe ratio exceeds ``benchmark``; NaN where it cannot be told."""
    if n < 3 or skew is None or kurtosis is None:
        return math.nan
    spread = 1 - skew * sharpe + (kurtosis + 2) / 4 * sharpe**2
    return normal_cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread)) if spread > 0 else math.nan


def expected_max_sharpe(n_trials: int, sigma: float) -> float:
    if n_trials < 2:
        return 0.0
    return sigma * ((1 - EULER_GAMMA) * normal_quantile(1 - 1 / n_trials) + EULER_GAMMA * normal_quantile(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(sharpe: float, n: int, skew: float | None, kurtosis: float | None, n_trials: int = 1, sigma: float | None = None) -> float:
    """The probabilistic ratio against the best of ``n_trials`` worthless ones."""
    if n < 3:
        return math.nan
    if sigma is None:
        sigma = math.sqrt((1 + sharpe**2 / 2) / (n - 1))
    return probabilistic_sharpe(sharpe, n, skew, kurtosis, expected_max_sharpe(n_trials, sigma))


def normal_shortfall(sigma: float, alpha: float = 0.95) -> float:
    return sigma * normal_density(normal_quantile(alpha)) / (1 - alpha)


def tail_verdict(cvar: float | None, sigma: float | None, alpha: float = 0.95) -> str:
    if cvar is None or not sigma:
        return "insufficient data"
    ratio = cvar / normal_shortfall(sigma, alpha)
    return "fat left tail" if ratio >= 1.5 else "moderately fat left tail" if ratio >= 1.15 else "near-normal tail"


def concentration_verdict(gains: float | None) -> str:
    if gains is None:
        return "insufficient data"
    return "few bars make the gains" if gains >= 0.5 else "somewhat concentrated" if gains >= 0.2 else "well spread"


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def summarize(returns: DataFrame, ppy: int = 252, n_trials: int = 1, alpha: float = 0.95) -> dict:
    """The headline scorecard of a ``backtest``; three small jobs over its rows."""
    m, t, d = _row(moments(returns, ppy=ppy)), _row(tail_risk(returns, alpha=alpha)), _row(drawdown_stats(returns))
    sigma = m["volatility"] / math.sqrt(ppy) if m["n"] > 1 else None
    psr = probabilistic_sharpe(m["sharpe_pp"], m["n"], m["skew"], m["kurtosis"])
    out = {
        "n_periods": m["n"], "cagr": m["cagr"], "volatility": m["volatility"], "sharpe": m["sharpe"], "sortino": m["sortino"],
        "max_drawdown": d["max_drawdown"], "calmar": m["cagr"] / abs(d["max_drawdown"]) if d["max_drawdown"] else None, "hit_rate": m["hit_rate"],
        "skew": m["skew"], "excess_kurtosis": m["kurtosis"], "jarque_bera_p": m["jarque_bera_p"], "var": t["var"], "cvar": t["cvar"],
        "normal_cvar": normal_shortfall(sigma, alpha) if sigma else None, "tail_verdict": tail_verdict(t["cvar"], sigma, alpha), "psr": psr,
        "dsr": deflated_sharpe(m["sharpe_pp"], m["n"], m["skew"], m["kurtosis"], n_trials), "n_trials": n_trials, "gain_hhi": m["gain_hhi"], "loss_hhi": m["loss_hhi"],
        "concentration_verdict": concentration_verdict(m["gain_hhi"]), "longest_drawdown": d["longest"], "drawdown_episodes": d["episodes"],
        "returns_are_normal": None if m["jarque_bera_p"] is None else m["jarque_bera_p"] > 0.05,
    }
    if "turnover" in returns.columns:
        extra = returns.agg(F.avg("turnover").alias("avg_turnover"), F.try_divide(F.avg("book"), F.avg(F.col("turnover") / 2)).alias("avg_holding_period")).first()
        out |= extra.asDict()
    return out


def backtest_stats(returns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of ``keys`` (a grid's configurations, say): concentration of gains and losses, drawdown, and where there are books, holding.

    (gain_hhi, loss_hhi, max_drawdown, longest, episodes[, holding_period]) of a ``backtest`` (seq, net, equity[, book, turnover]).
    """
    shares = moments(returns, keys=keys).select(*keys, "gain_hhi", "loss_hhi")
    parts = [drawdown_stats(returns, keys)]
    if {"book", "turnover"} <= set(returns.columns):
        held = F.try_divide(F.avg("book"), F.avg(F.col("turnover") / 2)).alias("holding_period")
        parts.append(returns.groupBy(*keys).agg(held) if keys else returns.agg(held))
    for part in parts:
        shares = shares.join(part, list(keys)) if keys else shares.crossJoin(part)  # one row each without keys
    return shares
