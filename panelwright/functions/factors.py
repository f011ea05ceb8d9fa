"""Factors as column expressions over the dense symbol-by-date panel.

A factor is a set of raw columns (time windows of one symbol, row arithmetic) and a combination of them
(z-scores of one date). All raw columns of a request are computed under one symbol window, all scores
under one date window: two shuffles for any number of factors. No factor looks ahead.

Look-backs are rows of the dense grid; ``Bars`` holds them for a bar size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import avg2, binary, blend, change, delta, lag, rolling, safe_div, zprod, zscore, zsum


@dataclass(frozen=True)
class Bars:
    """Look-backs in rows, and rows a year."""

    year: int = 252
    momentum: int = 126
    skip: int = 21
    volatility: int = 63
    reversal: int = 21
    illiquidity: int = 21
    momentum_year: int = 252


DAILY = Bars()
WEEKLY = Bars(year=52, momentum=26, skip=4, volatility=13, reversal=4, illiquidity=4, momentum_year=52)

#: Metrics of the observation table (fixed values), and further ones that only some screens use.
METRICS = """revenue cogs gross_profit sga rnd ebit interest_expense net_income shares_diluted total_assets current_assets cash
receivables inventory current_liabilities accounts_payable current_debt long_term_debt total_liabilities common_equity
retained_earnings op_cash_flow capex""".split()
EXTRA_METRICS = "ppe_net depreciation securities taxes_payable income_cont_ops short_term_debt".split()
RATIO_METRICS = "roe gross_profitability leverage eps_ttm bvps sps".split()


def metric(df_columns: list[str] | None, name: str) -> Column:
    """A metric's column, all NULL where the panel lacks it."""
    return F.col(name) if df_columns is None or name in df_columns else F.lit(None).cast("double")


# Price factors.


def momentum(bars: Bars) -> Column:
    return safe_div(lag("close", bars.skip), lag("close", bars.momentum)) - 1


def momentum_12_1(bars: Bars) -> Column:
    return safe_div(lag("close", bars.skip), lag("close", bars.momentum_year)) - 1


def trailing_volatility(bars: Bars) -> Column:
    """Needs the panel's ``ret`` (one-row change) column."""
    return rolling(F.stddev_samp, F.col("ret"), bars.volatility, bars.volatility) * float(bars.year) ** 0.5


def short_term_reversal(bars: Bars) -> Column:
    return -change("close", bars.reversal)


def amihud_illiquidity(bars: Bars) -> Column:
    impact = safe_div(F.abs(F.col("ret")), F.col("close") * F.col("volume"))
    return rolling(F.avg, impact, bars.illiquidity, max(2, bars.illiquidity // 2))


# Fundamental factors: each takes ``m``, a lookup of metric columns.


def market_cap(m) -> Column:
    return F.col("close") * m("shares_diluted")


def enterprise_value(m) -> Column:
    return market_cap(m) + m("current_debt") + m("long_term_debt") - m("cash")


def gross_profitability(m, bars) -> Column:
    return safe_div(m("revenue") - m("cogs"), m("total_assets"))


def operating_profitability(m, bars) -> Column:
    return safe_div(m("revenue") - m("cogs") - m("sga") - m("interest_expense"), m("common_equity"))


def roa(m, bars) -> Column:
    return safe_div(m("net_income"), m("total_assets"))


def roe(m, bars) -> Column:
    return safe_div(m("net_income"), m("common_equity"))


def gross_margin(m, bars) -> Column:
    return safe_div(m("revenue") - m("cogs"), m("revenue"))


def operating_margin(m, bars) -> Column:
    return safe_div(m("ebit"), m("revenue"))


def asset_turnover(m, bars) -> Column:
    return safe_div(m("revenue"), m("total_assets"))


def earnings_yield(m, bars) -> Column:
    return safe_div(m("net_income"), market_cap(m))


def book_to_price(m, bars) -> Column:
    return safe_div(m("common_equity"), market_cap(m))


def sales_to_price(m, bars) -> Column:
    return safe_div(m("revenue"), market_cap(m))


def fcf_yield(m, bars) -> Column:
    return safe_div(m("op_cash_flow") - m("capex"), market_cap(m))


def leverage(m, bars) -> Column:
    return safe_div(m("current_debt") + m("long_term_debt"), m("total_assets"))


def current_ratio(m, bars) -> Column:
    return safe_div(m("current_assets"), m("current_liabilities"))


def sloan_accruals(m, bars) -> Column:
    return safe_div(m("net_income") - m("op_cash_flow"), m("total_assets"))


def asset_growth(m, bars) -> Column:
    before = lag(m("total_assets"), bars.year)
    return safe_div(m("total_assets") - before, before)


def net_equity_issuance(m, bars) -> Column:
    ratio = safe_div(m("shares_diluted"), lag(m("shares_diluted"), bars.year))
    return F.ln(F.when(ratio > 0, ratio))


def altman_z(m, bars) -> Column:
    ta = m("total_assets")
    return (
        1.2 * safe_div(m("current_assets") - m("current_liabilities"), ta)
        + 1.4 * safe_div(m("retained_earnings"), ta)
        + 3.3 * safe_div(m("ebit"), ta)
        + 0.6 * safe_div(market_cap(m), m("total_liabilities"))
        + 1.0 * safe_div(m("revenue"), ta)
    )


def piotroski_f(m, bars) -> Column:
    """Nine binary tests; NULL unless seven of them can be made."""
    one = lambda name: lag(m(name), bars.year)
    two = lambda name: lag(m(name), 2 * bars.year)
    ta, ta1, ta2 = m("total_assets"), one("total_assets"), two("total_assets")
    returns, cash = safe_div(m("net_income"), ta1), safe_div(m("op_cash_flow"), ta1)
    tests = [
        binary(returns > 0),
        binary(cash > 0),
        binary(delta(returns, safe_div(one("net_income"), ta2)) > 0),
        binary(cash > returns),
        binary(delta(safe_div(m("long_term_debt"), avg2(ta, ta1)), safe_div(one("long_term_debt"), avg2(ta1, ta2))) < 0),
        binary(delta(safe_div(m("current_assets"), m("current_liabilities")), safe_div(one("current_assets"), one("current_liabilities"))) > 0),
        binary(delta(m("shares_diluted"), one("shares_diluted")) <= 0),
        binary(delta(safe_div(m("gross_profit"), m("revenue")), safe_div(one("gross_profit"), one("revenue"))) > 0),
        binary(delta(safe_div(m("revenue"), ta1), safe_div(one("revenue"), ta2)) > 0),
    ]
    made = sum(t.isNotNull().cast("int") for t in tests)
    return F.when(made >= 7, sum(F.coalesce(t, F.lit(0.0)) for t in tests))


def ohlson_o(m, bars) -> Column:
    ta, tl, ni = m("total_assets"), m("total_liabilities"), m("net_income")
    ni1 = lag(ni, bars.year)
    return (
        -1.32
        - 0.407 * F.ln(F.when(ta > 0, ta))
        + 6.03 * safe_div(tl, ta)
        - 1.43 * safe_div(m("current_assets") - m("current_liabilities"), ta)
        + 0.0757 * safe_div(m("current_liabilities"), m("current_assets"))
        - 1.72 * binary(tl > ta)
        - 2.37 * safe_div(ni, ta)
        - 1.83 * safe_div(m("op_cash_flow"), tl)
        + 0.285 * binary((ni < 0) & (ni1 < 0))
        - 0.521 * safe_div(ni - ni1, F.abs(ni) + F.abs(ni1))
    )


def beneish_m(m, bars) -> Column:
    one = lambda name: lag(m(name), bars.year)
    ratio = lambda a, b: safe_div(m(a), m(b))
    ratio1 = lambda a, b: safe_div(one(a), one(b))
    hard = lambda f: 1 - safe_div(f("current_assets") + f("ppe_net") + f("securities"), f("total_assets"))
    wear = lambda f: safe_div(f("depreciation"), f("depreciation") + f("ppe_net"))
    debt = lambda f: safe_div(f("current_liabilities") + f("long_term_debt"), f("total_assets"))
    return (
        -4.84
        + 0.92 * safe_div(ratio("receivables", "revenue"), ratio1("receivables", "revenue"))
        + 0.528 * safe_div(ratio1("gross_profit", "revenue"), ratio("gross_profit", "revenue"))
        + 0.404 * safe_div(hard(m), hard(one))
        + 0.892 * safe_div(m("revenue"), one("revenue"))
        + 0.115 * safe_div(wear(one), wear(m))
        - 0.172 * safe_div(ratio("sga", "revenue"), ratio1("sga", "revenue"))
        + 4.679 * safe_div(m("income_cont_ops") - m("op_cash_flow"), m("total_assets"))
        - 0.327 * safe_div(debt(m), debt(one))
    )


SIMPLE: dict[str, Callable] = {
    f.__name__: f
    for f in (
        gross_profitability, operating_profitability, roa, roe, gross_margin, operating_margin, asset_turnover, earnings_yield,
        book_to_price, sales_to_price, fcf_yield, leverage, current_ratio, sloan_accruals, asset_growth, net_equity_issuance,
        altman_z, piotroski_f, ohlson_o, beneish_m,
    )
}
SIMPLE |= {
    "momentum": lambda m, bars: momentum(bars),
    "momentum_12_1": lambda m, bars: momentum_12_1(bars),
    "trailing_volatility": lambda m, bars: trailing_volatility(bars),
    "short_term_reversal": lambda m, bars: short_term_reversal(bars),
    "amihud_illiquidity": lambda m, bars: amihud_illiquidity(bars),
    "ebit_to_ev": lambda m, bars: safe_div(m("ebit"), enterprise_value(m)),
    "ratio_earnings_yield": lambda m, bars: F.try_divide(m("eps_ttm"), F.col("close")),
    "ratio_book_to_price": lambda m, bars: F.try_divide(m("bvps"), F.col("close")),
    "ratio_sales_to_price": lambda m, bars: F.try_divide(m("sps"), F.col("close")),
    "ratio_roe": lambda m, bars: m("roe"),
    "ratio_gross_profitability": lambda m, bars: m("gross_profitability"),
    "ratio_leverage": lambda m, bars: m("leverage"),
}

#: Composite name -> (simple factors it needs, combination of their z-scores).
COMPOSITE: dict[str, tuple[tuple[str, ...], Callable]] = {
    "quality_score": (("gross_profitability", "roe", "operating_margin", "sloan_accruals", "leverage"), lambda z: blend(z("gross_profitability"), z("roe"), z("operating_margin"), z("sloan_accruals", -1), z("leverage", -1))),
    "value_score": (("earnings_yield", "book_to_price", "sales_to_price", "fcf_yield"), lambda z: blend(z("earnings_yield"), z("book_to_price"), z("sales_to_price"), z("fcf_yield"))),
    "value_with_fraud_guardrail": (("book_to_price", "ebit_to_ev", "beneish_m", "ohlson_o"), lambda z: zsum(z("book_to_price"), z("ebit_to_ev"), -z("beneish_m"), -z("ohlson_o"))),
    "profitable_value": (("book_to_price", "gross_profitability"), lambda z: zprod(z("book_to_price"), z("gross_profitability"))),
    "conservative_compounder": (("gross_profitability", "asset_growth", "trailing_volatility"), lambda z: zsum(z("gross_profitability"), -z("asset_growth"), -z("trailing_volatility"))),
    "ratio_value_score": (("ratio_earnings_yield", "ratio_book_to_price", "ratio_sales_to_price"), lambda z: blend(z("ratio_earnings_yield"), z("ratio_book_to_price"), z("ratio_sales_to_price"))),
    "ratio_quality_score": (("ratio_roe", "ratio_gross_profitability", "ratio_leverage"), lambda z: blend(z("ratio_roe"), z("ratio_gross_profitability"), z("ratio_leverage", -1))),
    "blend_price": (("momentum", "trailing_volatility", "short_term_reversal"), lambda z: blend(z("momentum"), z("trailing_volatility", -1), z("short_term_reversal"))),
}
COMPOSITE["value_quality_score"] = (
    COMPOSITE["ratio_value_score"][0] + COMPOSITE["ratio_quality_score"][0],
    lambda z: blend(COMPOSITE["ratio_value_score"][1](z), COMPOSITE["ratio_quality_score"][1](z)),
)
#: Orientation of a factor as a score: -1 where small values are good.
SIGN = {"leverage": -1, "sloan_accruals": -1, "asset_growth": -1, "net_equity_issuance": -1, "ohlson_o": -1, "beneish_m": -1, "trailing_volatility": -1}


def resolve(name: str) -> str:
    if name not in SIMPLE and name not in COMPOSITE:
        raise ValueError(f"unknown factor {name!r}; known: {', '.join(sorted({*SIMPLE, *COMPOSITE}))}")
    return name


def add_factors(panel: DataFrame, *names: str, bars: Bars = DAILY) -> DataFrame:
    """``panel`` with a column per factor, raw values for simple factors and scores for composites."""
    simple = sorted({s for n in map(resolve, names) for s in (COMPOSITE[n][0] if n in COMPOSITE else (n,))})
    columns = panel.columns
    if "ret" not in columns:
        panel = panel.withColumn("ret", change("close"))
    have = panel.columns
    raw = panel.select("*", *[SIMPLE[s](lambda name: metric(have, name), bars).alias(f"_{s}") for s in simple])
    z = lambda name, sign=1: zscore(F.col(f"_{name}") * sign)
    scored = raw.select(*columns, *[(COMPOSITE[n][1](z) if n in COMPOSITE else F.col(f"_{n}")).alias(n) for n in names])
    return scored


def add_scores(panel: DataFrame, variants: dict[str, tuple[str, Bars]]) -> DataFrame:
    """``panel`` with a score column per variant (factor and look-backs): one window of each order for all of them."""
    columns = panel.columns
    panel = panel if "ret" in columns else panel.withColumn("ret", change("close"))
    have = panel.columns
    parts = lambda name: COMPOSITE[name][0] if name in COMPOSITE else (name,)
    raw = panel.select("*", *[SIMPLE[s](lambda m: metric(have, m), bars).alias(f"_{v}_{s}") for v, (name, bars) in variants.items() for s in parts(resolve(name))])

    def score(variant: str, name: str) -> Column:
        z = lambda s, sign=1: zscore(F.col(f"_{variant}_{s}") * sign)
        return COMPOSITE[name][1](z) if name in COMPOSITE else z(name, SIGN.get(name, 1))

    return raw.select(*columns, *[score(v, resolve(name)).alias(v) for v, (name, _) in variants.items()])


def add_score(panel: DataFrame, name: str, bars: Bars = DAILY, as_col: str = "score") -> DataFrame:
    """The factor as a score to rank by: oriented, z-scored if it is a simple factor."""
    scored = add_factors(panel, name, bars=bars)
    value = F.col(name) if name in COMPOSITE else zscore(F.col(name) * SIGN.get(name, 1))
    return scored.withColumn(as_col, value).drop(*([name] if name != as_col else []))
