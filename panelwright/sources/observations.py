"""Vendor tables to the long observation table [symbol, period_end, available_date, metric, value]."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import finite

OBS_SCHEMA = "symbol string, period_end date, available_date date, metric string, value double"

# Canonical metric -> vendor column, as the vendors' public documentation names them.
SIMFIN_INCOME = {
    "revenue": "Revenue", "cogs": "Cost of Revenue", "gross_profit": "Gross Profit", "sga": "Selling, General & Administrative",
    "rnd": "Research & Development", "ebit": "Operating Income (Loss)", "interest_expense": "Interest Expense, Net",
    "net_income": "Net Income", "shares_diluted": "Shares (Diluted)",
}
SIMFIN_BALANCE = {
    "total_assets": "Total Assets", "current_assets": "Total Current Assets", "cash": "Cash, Cash Equivalents & Short Term Investments",
    "receivables": "Accounts & Notes Receivable", "inventory": "Inventories", "current_liabilities": "Total Current Liabilities",
    "accounts_payable": "Payables & Accruals", "current_debt": "Short Term Debt", "long_term_debt": "Long Term Debt",
    "total_liabilities": "Total Liabilities", "common_equity": "Total Equity", "retained_earnings": "Retained Earnings",
}
SIMFIN_CASHFLOW = {"op_cash_flow": "Net Cash from Operating Activities", "capex": "Change in Fixed Assets & Intangibles"}
SHARADAR_SF1 = {
    "revenue": "revenue", "cogs": "cor", "gross_profit": "gp", "sga": "sgna", "rnd": "rnd", "ebit": "opinc", "interest_expense": "intexp",
    "net_income": "netinc", "shares_diluted": "shareswadil", "total_assets": "assets", "current_assets": "assetsc", "cash": "cashneq",
    "receivables": "receivables", "inventory": "inventory", "current_liabilities": "liabilitiesc", "accounts_payable": "payables",
    "current_debt": "debtc", "long_term_debt": "debtnc", "total_liabilities": "liabilities", "common_equity": "equity",
    "retained_earnings": "retearn", "op_cash_flow": "ncfo", "capex": "capex",
}
AS_REPORTED = ("ARQ", "ART", "ARY")


def unpivot_vendor(df: DataFrame, field_map: dict[str, str], symbol_col: str, period_end_col: str, available_date_col: str) -> DataFrame:
    """Mapped columns that exist become rows; unreadable dates and values are dropped.

    A missing key column raises KeyError; with no mapped column the result is empty.
    """
    missing = [c for c in (symbol_col, period_end_col, available_date_col) if c not in df.columns]
    if missing:
        raise KeyError(f"vendor table lacks {missing}")
    present = {m: c for m, c in field_map.items() if c in df.columns}
    if not present:
        return df.sparkSession.createDataFrame([], OBS_SCHEMA)
    day = lambda c: F.to_date(F.try_to_timestamp(F.col(f"`{c}`").cast("string")))
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    wide = df.select(
        F.col(f"`{symbol_col}`").cast("string").alias("symbol"), day(period_end_col).alias("period_end"), day(available_date_col).alias("available_date"),
        *[finite(number(c)).alias(m) for m, c in present.items()],
    )
    return wide.unpivot(["symbol", "period_end", "available_date"], list(present), "metric", "value").dropna(subset=["period_end", "available_date", "value"])


def between(obs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Observations that became known from ``start`` to ``end``."""
    if start:
        obs = obs.where(F.col("available_date") >= F.to_date(F.lit(start)))
    return obs.where(F.col("available_date") <= F.to_date(F.lit(end))) if end else obs


def simfin(income: DataFrame, balance: DataFrame, cashflow: DataFrame, symbols: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Three restated bulk tables (not point-in-time) as observations."""
    wanted = [s.upper() for s in symbols]
    parts = [
        unpivot_vendor(t.withColumn("Ticker", F.upper(F.trim("Ticker"))).where(F.col("Ticker").isin(wanted)), m, "Ticker", "Report Date", "Publish Date")
        for t, m in ((income, SIMFIN_INCOME), (balance, SIMFIN_BALANCE), (cashflow, SIMFIN_CASHFLOW))
    ]
    return between(reduce(DataFrame.unionByName, parts), start, end)


def sharadar(sf1: DataFrame, symbols: list[str], dimension: str = "ARQ", start: str | None = None, end: str | None = None) -> DataFrame:
    """As-reported fundamentals; symbol, dimension and start filters reach the scan."""
    if dimension not in AS_REPORTED:
        raise ValueError(f"dimension must be one of {AS_REPORTED}: others are restated")
    rows = sf1.where(F.col("ticker").isin([s.upper() for s in symbols]) & (F.col("dimension") == dimension))
    if start:
        rows = rows.where(F.col("datekey") >= start)
    return between(unpivot_vendor(rows, SHARADAR_SF1, "ticker", "reportperiod", "datekey"), start, end)


def require_key(variable: str, signup: str) -> str:
    """A vendor key from the environment, read only when a vendor is asked for."""
    key = os.environ.get(variable)
    if not key:
        raise RuntimeError(f"set {variable}; keys are given at {signup}")
    return key


PROVIDERS: dict[str, Callable[..., DataFrame]] = {"simfin": simfin, "sharadar": sharadar}


def provider(name: str) -> Callable[..., DataFrame]:
    """A fundamentals source by name."""
    from .synthetic import synthetic_observations

    known = PROVIDERS | {"synthetic": synthetic_observations}
    if name not in known:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


def price_file(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(symbol, date, close, volume) from files; missing closes carry the last one, dates without any close go."""
    from .panel import densify, drop_empty_dates, forward_fill, trading_calendar

    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    prices = reader.format(kind).schema("symbol string, date date, close double, volume double").load(path)
    return drop_empty_dates(forward_fill(densify(prices, trading_calendar(prices)), "close"))
