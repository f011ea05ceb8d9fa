"""From a request to a verdict: the two documents that the service returns."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, forward_return, zscore
from ..functions.factors import EXTRA_METRICS, METRICS, Bars, add_factors, add_score, add_scores
from ..operators import attribution, guards, metrics, models, out_of_sample, portfolio, signal_quality
from ..sources import synthetic

# Bounds of a request.
BOUNDS = {"periods": (120, 6000), "lookback": (5, 756), "cost_bps": (0.0, 200.0), "n_trials": (1, 100_000), "gross": (0.1, 3.0)}
MAX_SYMBOLS, MAX_TICKER = 50, 10
DEFAULTS = {"provider": "synthetic", "factor": "momentum", "periods": 1512, "lookback": 252, "skip": 21, "cost_bps": 5.0, "n_trials": 1, "gross": 1.0, "seed": 42, "start": "2015-01-02"}
PRICE_FACTORS = ("momentum", "reversal", "lowvol", "blend")
#: Public factor name -> (library name, orientation).
FUNDAMENTAL_FACTORS = {
    "value": ("ratio_value_score", 1), "quality": ("ratio_quality_score", 1), "value_quality": ("value_quality_score", 1), "earnings_yield": ("earnings_yield", 1),
    "book_to_price": ("book_to_price", 1), "fcf_yield": ("fcf_yield", 1), "gross_profitability": ("gross_profitability", 1), "operating_profitability": ("operating_profitability", 1),
    "roe": ("roe", 1), "roa": ("roa", 1), "earnings_quality": ("sloan_accruals", -1), "low_leverage": ("leverage", -1), "conservative_investment": ("asset_growth", -1),
    "low_issuance": ("net_equity_issuance", -1), "value_with_fraud_guardrail": ("value_with_fraud_guardrail", 1), "profitable_value": ("profitable_value", 1),
    "conservative_compounder": ("conservative_compounder", 1),
}
CAPS = {"reversal": 63, "lowvol": 252}
# Names and groups under which users choose factors.
LABELS = {
    "momentum": ("Momentum (12-1)", "Technical (price)"), "reversal": ("Short-term reversal", "Technical (price)"), "lowvol": ("Low volatility", "Technical (price)"), "blend": ("Blend (momentum + low-vol + reversal)", "Technical (price)"),
    "value": ("Value (composite)", "Value"), "earnings_yield": ("Earnings yield (E/P)", "Value"), "book_to_price": ("Book-to-price (B/P)", "Value"), "fcf_yield": ("Free-cash-flow yield", "Value"),
    "quality": ("Quality (composite)", "Quality"), "gross_profitability": ("Gross profitability", "Quality"), "operating_profitability": ("Operating profitability", "Quality"), "roe": ("Return on equity (ROE)", "Quality"),
    "roa": ("Return on assets (ROA)", "Quality"), "earnings_quality": ("Earnings quality (low accruals)", "Quality"), "low_leverage": ("Low leverage", "Quality"), "conservative_investment": ("Conservative investment", "Investment"),
    "low_issuance": ("Low share issuance", "Investment"), "value_with_fraud_guardrail": ("Value (fraud-guarded)", "Composite alpha"), "profitable_value": ("Profitable value", "Composite alpha"),
    "conservative_compounder": ("Conservative compounder", "Composite alpha"), "value_quality": ("Value + Quality", "Multi-factor"),
}


def catalogue() -> list[dict]:
    """The factors that a request may name: label, group, what data they need, and the column behind them with its orientation (-1: low is good)."""
    entries = []
    for name, (label, category) in LABELS.items():
        column, orientation = FUNDAMENTAL_FACTORS.get(name, (name, 1))
        entries.append({"name": name, "label": label, "category": category, "kind": "price" if name in PRICE_FACTORS else "fundamental", "column": column, "orientation": orientation})
    return entries


class RequestError(ValueError):
    """A request outside its bounds."""


def validate(request: dict) -> dict:
    """The request with defaults, numbers as numbers and symbols upper-cased."""
    p = {**DEFAULTS, **{k: v for k, v in request.items() if v is not None}}
    p["provider"], p["factor"] = str(p["provider"]).lower(), str(p["factor"]).lower()
    if p["provider"] not in ("synthetic", "table"):
        raise RequestError("provider must be synthetic or table")
    if p["factor"] not in (*PRICE_FACTORS, *FUNDAMENTAL_FACTORS):
        raise RequestError(f"unknown factor {p['factor']!r}")
    p["symbols"] = [s for s in (str(x).strip().upper() for x in p.get("symbols") or []) if s]
    if len(p["symbols"]) > MAX_SYMBOLS or any(len(s) > MAX_TICKER or not s.replace(".", "").replace("-", "").isalnum() for s in p["symbols"]):
        raise RequestError(f"at most {MAX_SYMBOLS} symbols of letters, digits, dots and dashes")
    for key, kind in (("periods", int), ("lookback", int), ("skip", int), ("cost_bps", float), ("n_trials", int), ("gross", float), ("seed", int)):
        try:
            p[key] = kind(p[key])
        except (TypeError, ValueError):
            raise RequestError(f"{key} must be a number") from None
        low, high = BOUNDS.get(key, (0, math.inf))
        if not low <= p[key] <= high:
            raise RequestError(f"{key} must be between {low} and {high}")
    if p["skip"] >= p["lookback"]:
        raise RequestError("skip must be shorter than lookback")
    try:
        datetime.date.fromisoformat(str(p["start"])[:10])
    except ValueError:
        raise RequestError("start must be a date") from None
    return p


def effective_lookback(factor: str, lookback: int) -> int:
    return min(lookback, CAPS.get(factor, lookback))


def price_factor(factor: str, lookback: int, skip: int, ppy: int = 252) -> tuple[str, Bars]:
    """The library's name and look-backs of a public price factor."""
    used = effective_lookback(factor, lookback)
    if factor == "blend":
        return "blend_price", Bars(year=ppy, momentum=lookback, skip=skip, volatility=min(lookback, CAPS["lowvol"]), reversal=21)
    return {"momentum": "momentum", "reversal": "short_term_reversal", "lowvol": "trailing_volatility"}[factor], Bars(year=ppy, momentum=lookback, skip=skip, volatility=used, reversal=used)


def price_score(panel: DataFrame, factor: str, lookback: int, skip: int, ppy: int = 252) -> DataFrame:
    """``panel`` with ``score`` of a price factor."""
    return add_score(panel, *price_factor(factor, lookback, skip, ppy))


def load(spark: SparkSession, p: dict, tables: dict[str, DataFrame] | None) -> DataFrame:
    """The panel: given tables, or a synthetic world with fundamentals where the factor needs them."""
    if p["provider"] == "table":
        if not tables or "panel" not in tables:
            raise RequestError("provider table needs a panel")
        return tables["panel"]
    symbols = p["symbols"] or [f"S{i:02d}" for i in range(15)]
    if p["factor"] in PRICE_FACTORS:
        return synthetic.price_panel(spark, symbols, p["periods"], p["start"], p["seed"])
    if p["periods"] < 400:
        raise RequestError("fundamental factors need at least 400 periods")
    from ..operators.point_in_time import place

    world = synthetic.synthetic_world(spark, symbols, p["periods"], p["start"], p["seed"])
    if FUNDAMENTAL_FACTORS[p["factor"]][0].startswith(("ratio", "value_quality")):
        obs, names = synthetic.synthetic_observations(world, seed=p["seed"]), ["roe", "gross_profitability", "leverage", "eps_ttm", "bvps", "sps"]
    else:
        obs, names = synthetic.synthetic_raw_observations(world, seed=p["seed"]), [*METRICS, *EXTRA_METRICS]
    return place(obs, world, world.select("date", "seq").distinct(), names)


def clean(value):
    """JSON-safe: NaN and infinities as null, nested values walked."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def run_backtest(spark: SparkSession, request: dict, ledger: guards.TrialLedger | None = None, tables: dict[str, DataFrame] | None = None, ppy: int = 252) -> dict:
    """The verdict document of one strategy.

    Panel, weights and returns are persisted once; each section is a small job over them.
    """
    p = validate(request)
    price = p["factor"] in PRICE_FACTORS
    panel = load(spark, p, tables)
    own = not panel.is_cached  # a given table that is cached already stays so
    panel = panel.persist() if own else panel
    if price:
        scored = price_score(panel, p["factor"], p["lookback"], p["skip"], ppy)
    else:
        name, sign = FUNDAMENTAL_FACTORS[p["factor"]]
        raw = add_factors(panel, name)
        from ..functions.factors import COMPOSITE

        scored = raw.withColumn("score", F.col(name) if name in COMPOSITE else zscore(F.col(name) * sign)).drop(*([] if name in panel.columns else [name]))
    weights = portfolio.add_weights(scored, gross=p["gross"]).persist()
    returns = portfolio.equity(portfolio.portfolio(portfolio.positions(weights), p["cost_bps"])).persist()
    try:
        size = weights.agg(F.max("seq").alias("bars"), F.count_distinct("symbol").alias("symbols")).first()
        if size["symbols"] < 2 or size["bars"] < BOUNDS["periods"][0] or (price and size["bars"] <= p["lookback"] + p["skip"] + 21):
            raise RequestError("the panel is too small for this request")
        if ledger is not None:
            ledger.record(request)
        trials = ledger.effective(p["n_trials"]) if ledger is not None else p["n_trials"]
        scorecard = metrics.summarize(returns, ppy, trials)
        oos = out_of_sample.split_backtest(weights, size["bars"], cost_bps=p["cost_bps"], ppy=ppy)
        purge = effective_lookback(p["factor"], p["lookback"]) + p["skip"] if price else 0
        try:
            forward = out_of_sample.walk_forward(weights, size["bars"], 5, p["cost_bps"], ppy, purge, 1)
        except ValueError as e:
            forward = {"error": str(e)}
        credible = (forward["passes"] if "error" not in forward else (scorecard["dsr"] or 0) > 0.95) and not oos["overfit_warning"]
        factors = attribution.factor_returns(weights)
        curve = portfolio.downsample(returns.select("date", "seq", "equity", "drawdown")).orderBy("seq").collect()
        return clean({
            "meta": {**p, "effective_lookback": effective_lookback(p["factor"], p["lookback"]), "n_bars": size["bars"], "n_symbols": size["symbols"]},
            "verdict": {"credible": bool(credible), "label": "CREDIBLE" if credible else "NOT CREDIBLE"}, "scorecard": scorecard,
            "signal_quality": signal_quality.scorecard(weights), "out_of_sample": oos, "walk_forward": forward,
            "pbo": overfitting(panel, p, size["bars"], ppy) if price else {"error": "not defined for fundamental factors"},
            "trial_audit": {"declared": p["n_trials"], "effective": trials, "raised": trials > p["n_trials"]},
            "attribution": attribution.attribution(returns, factors, "ff5" if "common_equity" in weights.columns else "carhart4", ppy),
            "fat_tails": guards.fat_tails(returns).first().asDict(),
            "equity_curve": [[r["date"], r["equity"]] for r in curve], "drawdown_curve": [[r["date"], round(r["drawdown"], 6)] for r in curve],
        })
    finally:
        weights.unpersist()
        returns.unpersist()
        if own:
            panel.unpersist()


def overfitting(panel: DataFrame, p: dict, n_bars: int, ppy: int = 252) -> dict:
    """Probability of backtest overfitting over distinct look-backs around the one asked for."""
    base, cap = effective_lookback(p["factor"], p["lookback"]), CAPS.get(p["factor"], 756)
    looks = sorted({min(cap, max(5, round(base * f))) for f in (0.4, 0.6, 0.8, 1.0, 1.3)})
    if len(looks) < 2 or n_bars < 16:
        return {"error": "fewer than two configurations or too few bars"}
    weighted = add_scores(panel, {f"s{k}": price_factor(p["factor"], k, min(p["skip"], k - 1), ppy) for k in looks})
    for k in looks:
        weighted = portfolio.add_weights(weighted, f"s{k}", p["gross"], f"w{k}")
    returns = out_of_sample.grid_returns(weighted, {f"w{k}": f"w{k}" for k in looks}, p["cost_bps"])
    logits = out_of_sample.cscv_logits(out_of_sample.block_moments(returns, n_bars), ppy=ppy).persist()
    try:
        out = out_of_sample.pbo_summary(logits, len(looks))
    finally:
        logits.unpersist()
    return {**out, "slope": out["performance_degradation_slope"], "lookbacks": looks}


def run_model_comparison(panel: DataFrame, features: list[str], horizon: int = 21, n_folds: int = 6, embargo: float = 0.01, names: list[str] | None = None, bars: Bars | None = None) -> dict:
    """The leaderboard of forecasters over purged folds of the panel's factors."""
    if not 1 <= len(features) <= 12 or not 1 <= horizon <= 63:
        raise RequestError("1 to 12 features and a horizon of 1 to 63 bars")
    bars = bars or Bars()
    scored = add_factors(panel, *features, bars=bars)
    z = scored.select(
        "symbol", "sym_pos", "date", F.col("seq").alias("label_start"), F.lead("seq", horizon).over(by_symbol()).alias("label_end"), forward_return("close", horizon).alias("y"), *[zscore(f).alias(f) for f in features]
    )
    kept = z.where(F.col("y").isNotNull() & F.col("label_end").isNotNull() & F.coalesce(*features).isNotNull()).fillna(0.0, features)
    rows = out_of_sample.with_row(kept).persist()
    try:
        folds = out_of_sample.purged_folds(rows, None, n_folds, embargo).persist()
        out = models.compare(folds, features, n_folds, names, bars.year)
        folds.unpersist()
    finally:
        rows.unpersist()
    return clean({**out, "features": features, "horizon": horizon, "n_folds": n_folds})
