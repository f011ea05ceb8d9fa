"""Factor portfolios and the regression of a strategy on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, change, lag
from ..functions.factors import DAILY, Bars, add_factors, market_cap
from ..functions.normal import t_two_sided

MODELS = {
    "capm": ("MKT",), "ff3": ("MKT", "SMB", "HML"), "carhart4": ("MKT", "SMB", "HML", "UMD"),
    "ff5": ("MKT", "SMB", "HML", "RMW", "CMA"), "ff6": ("MKT", "SMB", "HML", "RMW", "CMA", "UMD"),
}
#: Portfolio -> (factor, orientation) of the score that sorts it.
SORTS = {"UMD": ("momentum_12_1", 1), "SMB": ("_cap", -1), "HML": ("book_to_price", 1), "RMW": ("operating_profitability", 1), "CMA": ("asset_growth", -1)}


def tercile_long_short(panel: DataFrame, scores: dict[str, str]) -> DataFrame:
    """(date, seq, name, ret): top less bottom third by the score of the bar before, for each named score column.

    Needs at least three names with score and return; ties go by symbol position.
    """
    shifted = panel.select("symbol", "sym_pos", "date", "seq", "ret", *[lag(c, 1, by_symbol()).alias(n) for n, c in scores.items()])
    long = shifted.unpivot(["sym_pos", "date", "seq", "ret"], list(scores), "name", "s").where("s is not null and ret is not null")
    part = Window.partitionBy("name", "date")
    ranked = long.select("name", "date", "seq", "ret", F.row_number().over(part.orderBy("s", "sym_pos")).alias("r"), F.count(F.lit(1)).over(part).alias("m")).where("m >= 3")
    third = F.expr("m div 3")
    top, bottom = F.avg(F.when(F.col("r") > F.col("m") - third, F.col("ret"))), F.avg(F.when(F.col("r") <= third, F.col("ret")))
    return ranked.groupBy("name", "date", "seq").agg((top - bottom).alias("ret"))


def factor_returns(panel: DataFrame, bars: Bars = DAILY) -> DataFrame:
    """(date, seq, MKT, UMD[, SMB, HML, RMW, CMA]): the latter where the panel holds fundamentals."""
    panel = panel if "ret" in panel.columns else panel.withColumn("ret", change("close"))
    names = ["UMD"] + (["SMB", "HML", "RMW", "CMA"] if "common_equity" in panel.columns else [])
    wanted = [SORTS[n][0] for n in names if SORTS[n][0] != "_cap"]
    scored = add_factors(panel, *wanted, bars=bars)
    if "SMB" in names:
        scored = scored.withColumn("_cap", market_cap(F.col))
    scored = scored.withColumns({f"_s{n}": F.col(SORTS[n][0]) * SORTS[n][1] for n in names})
    sorted_ = tercile_long_short(scored, {n: f"_s{n}" for n in names}).groupBy("date", "seq").pivot("name", names).agg(F.first("ret"))
    market = panel.groupBy("date", "seq").agg(F.avg("ret").alias("MKT"))
    return market.join(sorted_, ["date", "seq"], "left")


def ols(data: DataFrame, y: str, xs: list[str]) -> dict:
    """Least squares with intercept from one pass of cross-products; rows with a NULL are left out."""
    names = [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]
    p = len(xs) + 1
    known = data.dropna(subset=[y, *xs])
    sums = [F.sum(names[i] * names[j]).alias(f"s{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
    row = known.agg(*sums).first()
    full = np.zeros((p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            full[i, j] = full[j, i] = row[f"s{i}_{j}"] or 0.0
    xx, xy, yy, n = full[:p, :p], full[:p, p], full[p, p], int(full[0, 0])
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    residual = max(yy - beta @ xy, 0.0)
    total = yy - xy[0] ** 2 / n if n else 0.0
    dof = n - p
    error = np.sqrt(np.maximum(np.diag(inverse) * residual / dof, 0)) if dof > 0 else np.full(p, np.nan)
    t = [float(b / e) if e > 0 else None for b, e in zip(beta, error, strict=True)]
    return {
        "n": n, "dof": dof, "coef": [float(b) for b in beta], "t": t, "p": [None if v is None else t_two_sided(v, dof) for v in t],
        "r2": float(1 - residual / total) if total > 0 else 0.0, "residual_ss": float(residual), "total_ss": float(total),
    }


def attribution(strategy: DataFrame, factors: DataFrame, model: str = "capm", ppy: int = 252, least: int = 60) -> dict:
    """Alpha, betas and the systematic share of variance of ``strategy`` (date, net)."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(MODELS)}")
    present = [f for f in MODELS[model] if f in factors.columns]
    missing = [f for f in MODELS[model] if f not in factors.columns]
    joined = strategy.select("date", "net").join(factors.select("date", *present), "date")
    fit = ols(joined, "net", present)
    if fit["n"] < least:
        return {"model": model, "insufficient": True, "n": fit["n"], "missing_factors": missing}
    share = 1 - fit["residual_ss"] / fit["total_ss"] if fit["total_ss"] > 0 else 0.0
    alpha_t = fit["t"][0]
    mostly_beta = share >= 0.8 and alpha_t is not None and abs(alpha_t) < 2
    return {
        "model": model, "insufficient": False, "n": fit["n"], "missing_factors": missing, "alpha_annual": (1 + fit["coef"][0]) ** ppy - 1, "alpha_t": alpha_t,
        "alpha_p": fit["p"][0], "betas": dict(zip(present, fit["coef"][1:], strict=True)), "beta_t": dict(zip(present, fit["t"][1:], strict=True)), "r2": fit["r2"],
        "systematic_share": share, "verdict": "mostly beta" if mostly_beta else "has alpha" if alpha_t is not None and alpha_t >= 2 else "no significant alpha",
    }


def sweep(matrix: np.ndarray, k: int) -> np.ndarray:
    """The sweep operator on pivot ``k``: variable k enters a regression whose cross-products ``matrix`` holds.

    With a set of variables swept in, the last column has their coefficients and its corner the residual sum of squares; the
    swept block is minus the inverse of their cross-products. A pivot that is a combination of those before is left out.
    """
    d = matrix[k, k]
    if abs(d) < 1e-14:
        return matrix
    out = matrix - np.outer(matrix[:, k], matrix[k]) / d
    out[k], out[:, k] = matrix[k] / d, matrix[:, k] / d
    out[k, k] = -1 / d
    return out


def nested_models(strategy: DataFrame, factors: DataFrame, order: tuple[str, ...] = MODELS["ff6"], ppy: int = 252) -> list[dict]:
    """CAPM up to all of ``order``, a factor more each time, from one aggregate of products.

    Only dates on which all factors are known count, so models are of the same dates. Each entry has the factors so far, n, alpha
    (a year), its t, the betas and their t, and the share of variance explained.
    """
    present = [f for f in order if f in factors.columns]
    joined = strategy.select("date", F.col("net").alias("_y")).join(factors.select("date", *present), "date").dropna()
    columns = [F.lit(1.0), *[F.col(f"`{f}`") for f in present], F.col("_y")]
    p = len(columns)
    row = joined.agg(*[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    gram = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            gram[i, j] = gram[j, i] = row[f"s{i}_{j}"] or 0.0
    n, out = int(gram[0, 0]), []
    if not n:
        return out
    swept = sweep(gram, 0)
    total = swept[-1, -1]
    for k, _ in enumerate(present, 1):
        swept = sweep(swept, k)
        dof, residual = n - k - 1, max(float(swept[-1, -1]), 0.0)
        if dof <= 0:
            break
        error = np.sqrt(np.maximum(-np.diag(swept)[: k + 1], 0) * residual / dof)
        t = [float(c / e) if e > 0 else None for c, e in zip(swept[: k + 1, -1], error, strict=True)]
        out.append({
            "factors": present[:k], "n": n, "dof": dof, "alpha": float(swept[0, -1]), "alpha_annual": float((1 + swept[0, -1]) ** ppy - 1), "alpha_t": t[0],
            "betas": dict(zip(present[:k], map(float, swept[1 : k + 1, -1]), strict=True)), "beta_t": dict(zip(present[:k], t[1:], strict=True)), "r2": float(1 - residual / total) if total > 0 else 0.0,
        })
    return out


def attribute(strategy: DataFrame, panel: DataFrame, model: str = "ff5", ppy: int = 252, bars: Bars = DAILY, least: int = 60) -> dict:
    """Factor portfolios of ``panel`` and the regression on them in one call.

    Without fundamentals a model falls back to its price factors; ``note`` says which were left out. All numbers are finite or None.
    """
    model = model.lower()
    factors = factor_returns(panel, bars)
    fit = attribution(strategy, factors, model, ppy, least)
    fundamentals = "common_equity" in panel.columns
    missing = fit["missing_factors"]
    note = "ok" if not missing else f"no {', '.join(missing)}: " + ("not in the panel" if fundamentals else "the panel holds prices only") + f"; fitted on {', '.join(f for f in MODELS[model] if f not in missing)}"
    finite = lambda v: {k: finite(x) for k, x in v.items()} if isinstance(v, dict) else None if isinstance(v, float) and not np.isfinite(v) else v
    return finite({**fit, "available_factors": [c for c in factors.columns if c not in ("date", "seq")], "fundamentals_used": fundamentals, "note": note})
