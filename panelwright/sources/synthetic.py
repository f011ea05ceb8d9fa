"""Seeded synthetic markets: one generator task per symbol, a market path shared by seed.

Every symbol's draws come from a generator seeded by (seed, symbol position), so results do not depend on
how symbols are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.point_in_time import first_bar
from ..operators.text_signals import NEGATIVE, POSITIVE

# Transition matrix of the calm (1) and rough (0) market, drift and spread in each.
STAY = np.array([[0.95, 0.05], [0.02, 0.98]])
DRIFT, SPREAD = {1: 0.0005, 0: -0.0009}, {1: 0.008, 0: 0.020}


def innovations(rng: np.random.Generator, n: int, fat_tails: bool = True, t_df: int = 4) -> np.ndarray:
    """Unit-variance shocks: Student's t scaled down, or normal."""
    if not fat_tails:
        return rng.standard_normal(n)
    if t_df <= 2:
        raise ValueError("t_df must exceed 2 for a finite variance")
    return rng.standard_t(t_df, n) / np.sqrt(t_df / (t_df - 2))


def market_path(periods: int, seed: int, fat_tails: bool, t_df: int) -> tuple[np.ndarray, np.ndarray]:
    """(states, returns) of the two-state market."""
    rng = np.random.default_rng([seed, 1])
    draws, states, state = rng.random(periods), np.empty(periods, int), 1
    for t in range(periods):
        state = state if t == 0 else int(draws[t] >= STAY[state][0])
        states[t] = state
    calm = states == 1
    shock = innovations(rng, periods, fat_tails, t_df)
    return states, np.where(calm, DRIFT[1], DRIFT[0]) + np.where(calm, SPREAD[1], SPREAD[0]) * shock


def synthetic_world(
    spark: SparkSession, symbols: list[str], periods: int = 1260, start: str = "2015-01-02", seed: int = 0, drift: float = 0.0006,
    persistence: float = 0.985, n_events: int = 12, fat_tails: bool = True, t_df: int = 4,
) -> DataFrame:
    """(symbol, sym_pos, date, seq, close, volume, quality, regime, sentiment): business days; sentiment on event days only.

    Returns load on yesterday's latent quality, an autoregression of unit variance.
    """
    dates = pd.bdate_range(start, periods=periods)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        pos, symbol = int(rows["pos"].iloc[0]), rows["symbol"].iloc[0]
        states, market = market_path(periods, seed, fat_tails, t_df)
        rng = np.random.default_rng([seed, 2, pos])
        shocks, quality = rng.standard_normal(periods), np.empty(periods)
        quality[0] = shocks[0]
        for t in range(1, periods):
            quality[t] = persistence * quality[t - 1] + np.sqrt(1 - persistence**2) * shocks[t]
        beta, spread = rng.uniform(0.6, 1.4), rng.uniform(0.15, 0.45) / np.sqrt(252) * 0.7
        ret = beta * market + drift * np.concatenate((quality[:1], quality[:-1])) + spread * innovations(rng, periods, fat_tails, t_df)
        volume = np.round(rng.uniform(5e5, 5e6) * np.exp(rng.normal(0, 0.2, periods)))
        picks = rng.choice(np.arange(10, periods - 5), min(n_events, max(0, periods - 15)), replace=False)
        sentiment = np.full(periods, np.nan)
        sentiment[picks] = np.tanh(quality[picks])
        return pd.DataFrame({
            "symbol": symbol, "sym_pos": pos + 1, "date": dates.date, "seq": np.arange(1, periods + 1), "close": 100 * np.cumprod(1 + ret), "volume": volume,
            "quality": quality, "regime": states, "sentiment": sentiment,
        })

    named = spark.createDataFrame(list(enumerate(symbols)), "pos int, symbol string")
    schema = "symbol string, sym_pos int, date date, seq int, close double, volume double, quality double, regime int, sentiment double"
    return named.groupBy("symbol").applyInPandas(one, schema).withColumn("sentiment", F.nanvl("sentiment", F.lit(None)))


def price_panel(spark: SparkSession, symbols: list[str], periods: int = 1260, start: str = "2015-01-02", seed: int = 0, **options) -> DataFrame:
    """Prices without a planted signal."""
    return synthetic_world(spark, symbols, periods, start, seed, drift=0.0, **options).drop("quality", "sentiment")


def gaussian(*key) -> Column:
    """A standard normal draw made from a hash of the key, the same wherever the row is."""
    uniform = lambda salt: (F.pmod(F.xxhash64(*key, F.lit(salt)), F.lit(2**52)) + 0.5) / float(2**52)
    return F.sqrt(-2 * F.ln(uniform("r"))) * F.cos(2 * np.pi * uniform("a"))


def synthetic_raw_observations(world: DataFrame, lag_days: int = 75, period_bars: int = 63, seed: int = 0) -> DataFrame:
    """Quarterly statements whose profitability follows latent quality: the canonical metrics and the extra ones."""
    noise = lambda k, sd: gaussian(F.col("symbol"), F.col("seq"), F.lit(seed * 211 + k)) * sd
    firm = lambda k, lo, hi: lo + (hi - lo) * F.pmod(F.xxhash64("symbol", F.lit(seed * 17 + k)), F.lit(10_000)) / 10_000.0
    q, assets = F.col("quality"), F.col("assets")
    base = world.where(F.col("seq") % period_bars == 0).withColumn("assets", firm(1, 5e8, 5e9) * F.exp(0.00008 * F.col("seq") + noise(1, 0.02)))
    revenue = assets * (0.8 + noise(2, 0.05))
    margin = F.greatest(F.lit(0.05), 0.30 + 0.10 * q + noise(3, 0.03))
    wide = base.select(
        "symbol", "seq", F.col("date").alias("period_end"), F.date_add("date", lag_days).alias("due"), q.alias("quality"), assets.alias("total_assets"), revenue.alias("revenue"),
        (assets * margin).alias("gross_profit"), (revenue * (0.12 + noise(4, 0.01))).alias("sga"), (revenue * (0.04 + noise(5, 0.005))).alias("rnd"),
        (assets * F.greatest(F.lit(0.05), 0.30 - 0.08 * q + noise(6, 0.03))).alias("long_term_debt"), (assets * F.greatest(F.lit(0.01), 0.06 - 0.01 * q + noise(7, 0.01))).alias("current_debt"),
        (assets * (0.40 + noise(8, 0.03))).alias("current_assets"), (assets * (0.22 + noise(9, 0.02))).alias("current_liabilities"), (firm(2, 5e7, 5e8) * (1 + 0.00002 * F.col("seq"))).alias("shares_diluted"),
        (assets * (0.12 + 0.02 * q + noise(10, 0.01))).alias("retained_earnings"), (assets * (0.35 + noise(11, 0.01))).alias("ppe_net"),
    )
    c = F.col
    full = wide.withColumns({
        "cogs": c("revenue") - c("gross_profit"), "ebit": c("gross_profit") - c("sga") - c("rnd"), "interest_expense": 0.05 * (c("long_term_debt") + c("current_debt")),
        "cash": 0.3 * c("current_assets"), "receivables": 0.25 * c("current_assets"), "inventory": 0.25 * c("current_assets"), "accounts_payable": 0.4 * c("current_liabilities"),
        "total_liabilities": c("current_liabilities") + c("current_debt") + c("long_term_debt"), "depreciation": 0.08 * c("ppe_net"), "securities": 0.02 * c("total_assets"), "taxes_payable": 0.01 * c("total_assets"),
        "short_term_debt": c("current_debt"), "capex": 0.09 * c("ppe_net"),
    })
    full = full.withColumn("net_income", 0.79 * (c("ebit") - c("interest_expense"))).withColumns({
        "income_cont_ops": c("net_income"), "op_cash_flow": c("net_income") + c("depreciation") + c("total_assets") * (0.01 * c("quality") + gaussian(c("symbol"), c("seq"), F.lit(seed * 211 + 12)) * 0.01),
        "common_equity": c("total_assets") - c("total_liabilities"),
    })
    calendar = world.select("date", "seq").distinct()
    bar = calendar.select(c("seq").alias("bar"), c("date").alias("available_date"))
    known = first_bar(full.drop("seq", "quality"), calendar, "due").join(bar, c("seq") == c("bar")).drop("due", "seq", "bar")
    names = [m for m in known.columns if m not in ("symbol", "period_end", "available_date")]
    return known.unpivot(["symbol", "period_end", "available_date"], names, "metric", "value")


def synthetic_observations(world: DataFrame, lag_days: int = 75, period_bars: int = 63, seed: int = 0) -> DataFrame:
    """Quarterly ratio metrics that follow latent quality (roe, gross_profitability, leverage) or price alone (eps_ttm, bvps, sps).

    Known ``lag_days`` after the period, on the next bar; periods known after the last bar are dropped.
    """
    periods = world.where(F.col("seq") % period_bars == 0)
    noise = lambda k, sd: gaussian(F.col("symbol"), F.col("seq"), F.lit(seed * 101 + k)) * sd
    calendar = world.select("date", "seq").distinct()
    wide = periods.select(
        "symbol", F.col("date").alias("period_end"), F.date_add("date", lag_days).alias("due"),
        (0.12 + 0.06 * F.col("quality") + noise(1, 0.02)).alias("roe"), (0.30 + 0.10 * F.col("quality") + noise(2, 0.03)).alias("gross_profitability"),
        F.greatest(F.lit(0.05), 0.80 - 0.25 * F.col("quality") + noise(3, 0.10)).alias("leverage"), (F.col("close") * (0.05 + noise(4, 0.010))).alias("eps_ttm"),
        (F.col("close") * (0.50 + noise(5, 0.100))).alias("bvps"), (F.col("close") * (0.80 + noise(6, 0.150))).alias("sps"),
    )
    bar = calendar.select(F.col("seq").alias("bar"), F.col("date").alias("available_date"))
    known = first_bar(wide, calendar, "due").join(bar, F.col("seq") == F.col("bar")).drop("due", "seq", "bar")
    return known.unpivot(["symbol", "period_end", "available_date"], ["roe", "gross_profitability", "leverage", "eps_ttm", "bvps", "sps"], "metric", "value")


def sentiment_text(sentiment, key):
    """A snippet whose words lean as the sentiment does, chosen by a hash of ``key``."""
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(key, F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    n = F.greatest(F.lit(1), F.round(F.abs(sentiment) * 3).cast("int"))
    leaning = lambda words: F.array_join(F.slice(F.array(*[pick(words, k) for k in range(3)]), F.lit(1), n), ", ")
    return (
        F.when(sentiment > 0.1, F.concat(F.lit("The quarter was good; the team pointed to "), leaning(POSITIVE), F.lit(".")))
        .when(sentiment < -0.1, F.concat(F.lit("The quarter was poor; the team pointed to "), leaning(NEGATIVE), F.lit(".")))
        .otherwise(F.lit("The quarter was as expected and plans are unchanged."))
    )


def transcripts(world: DataFrame) -> DataFrame:
    """(symbol, date, text, latent_sentiment) of the world's events."""
    return world.where("sentiment is not null").select("symbol", "date", sentiment_text(F.col("sentiment"), F.concat_ws("-", "symbol", "seq")).alias("text"), F.col("sentiment").alias("latent_sentiment"))
