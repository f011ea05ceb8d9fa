"""Splits in time, purged cross-validation and backtest overfitting."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .portfolio import portfolio, positions

#: Most combinations of blocks that are formed.
MAX_COMBINATIONS = 13_000


def with_split(panel: DataFrame, n_bars: int, split: float = 0.7) -> DataFrame:
    """``fold`` 0 up to the cut and 1 after it."""
    return panel.withColumn("fold", (F.col("seq") > int(n_bars * split)).cast("int"))


def with_folds(panel: DataFrame, n_bars: int, n_splits: int = 5, lead: int = 0) -> DataFrame:
    """``fold`` 0 .. n_splits - 1, ``bar`` from 0 in the fold; weights of its first ``lead`` bars are 0."""
    if n_splits < 2 or n_bars < 2 * n_splits:
        raise ValueError("a longer series or fewer splits are needed")
    bounds = [n_bars * k // n_splits for k in range(n_splits + 1)]
    if lead < 0 or lead >= min(b - a for a, b in zip(bounds[1:], bounds[2:], strict=False)):
        raise ValueError("the lead must be at least 0 and shorter than the shortest fold")
    fold, start = F.lit(0), F.lit(0)
    for k in range(1, n_splits):
        fold, start = F.when(F.col("seq") > bounds[k], k).otherwise(fold), F.when(F.col("seq") > bounds[k], bounds[k]).otherwise(start)
    marked = panel.withColumns({"fold": fold, "bar": (F.col("seq") - 1 - start).cast("int")})
    return marked.withColumn("weight", F.when(F.col("bar") < lead, 0.0).otherwise(F.col("weight")))


def fold_returns(folded: DataFrame, cost_bps: float = 5.0, lead: int = 0) -> DataFrame:
    """(fold, date, seq, net, ...): each fold starts flat; its first ``lead`` bars are not scored."""
    out = portfolio(positions(folded, 1, ("fold",)), cost_bps, ("fold",))
    if not lead:
        return out
    first = F.min("seq").over(Window.partitionBy("fold"))
    return out.withColumn("_first", first).where(F.col("seq") >= F.col("_first") + lead).drop("_first")


def split_backtest(panel: DataFrame, n_bars: int, split: float = 0.7, cost_bps: float = 5.0, ppy: int = 252, threshold: float = 1.0) -> dict:
    rows = {r["fold"]: r for r in metrics.moments(fold_returns(with_split(panel, n_bars, split), cost_bps), ppy=ppy, keys=("fold",)).collect()}
    inside, outside = rows[0], rows[1]
    psr = metrics.probabilistic_sharpe(outside["sharpe_pp"], outside["n"], outside["skew"], outside["kurtosis"])
    gap = inside["sharpe"] - outside["sharpe"]
    return {
        "in_sample_sharpe": round(inside["sharpe"], 3), "out_sample_sharpe": round(outside["sharpe"], 3), "degradation": round(gap, 3),
        "out_sample_psr": None if math.isnan(psr) else round(psr, 3), "overfit_warning": gap > threshold, "oos_significant": not math.isnan(psr) and psr >= 0.95,
    }


def walk_forward(panel: DataFrame, n_bars: int, n_splits: int = 5, cost_bps: float = 5.0, ppy: int = 252, purge: int = 0, embargo: int = 0) -> dict:
    """Out-of-sample folds after the first, stitched and deflated for ``n_splits`` trials."""
    lead = purge + embargo
    returns = fold_returns(with_folds(panel, n_bars, n_splits, lead), cost_bps, lead).where("fold > 0")
    folds = metrics.moments(returns, ppy=ppy, keys=("fold",)).orderBy("fold").collect()
    m = metrics.moments(returns, ppy=ppy).first()
    dsr = metrics.deflated_sharpe(m["sharpe_pp"], m["n"], m["skew"], m["kurtosis"], n_splits)
    return {
        "n_splits": n_splits, "n_oos_folds": len(folds), "fold_sharpes": [round(f["sharpe"], 3) for f in folds], "stitched_sharpe": round(m["sharpe"], 3),
        "dsr": None if math.isnan(dsr) else round(dsr, 3), "purged_per_fold": [lead] * len(folds), "passes": not math.isnan(dsr) and dsr > 0.95,
    }


# Purged cross-validation over a feature table (row, label_start, label_end).


def embargo_rows(n: int, share: float) -> int:
    return math.ceil(n * share)


def embargo(n: str, share: float) -> Column:
    """``embargo_rows`` of a column of counts."""
    return F.ceil(F.col(n) * share).cast("long")


def with_row(features: DataFrame) -> DataFrame:
    """Rows numbered from 0 by date and symbol, and ``n_rows``, how many there are. The numbering is exact and distributed by date.

    Rows before a date are summed on one row a date; within a date the order is by symbol position.
    """
    sizes = features.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("date", (F.sum("_n").over(Window.orderBy("date")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("n_rows"))
    return features.join(before, "date").withColumn("row", F.col("_before") + F.row_number().over(Window.partitionBy("date").orderBy("sym_pos")) - 1).drop("_before")


def _counted(rows: DataFrame, n: int | None, parts: int, embargo: float) -> tuple[DataFrame, Column]:
    """(``rows`` with ``_skip``, the embargo in rows; the stretch of a row out of ``parts``): ``n`` rows, or as many as ``n_rows`` says."""
    total = F.col("n_rows") if n is None else F.lit(n)
    stretch = F.lit(parts - 1)
    for k in reversed(range(parts - 1)):
        stretch = F.when(F.col("row") < F.floor(total * (k + 1) / parts), k).otherwise(stretch)
    return rows.withColumn("_skip", F.ceil(total * embargo)), stretch


def purged_folds(rows: DataFrame, n: int | None = None, n_folds: int = 5, embargo: float = 0.01) -> DataFrame:
    """(fold, role, ...): each row of ``rows`` once per fold it tests in or trains for.

    Folds are equal stretches of rows. Training rows whose label interval meets the test rows' intervals
    or that follow them within the embargo are left out. The fold bounds are one row a fold.
    """
    return _with_roles(rows, n, n_folds, embargo).where("role is not null")


def left_out(rows: DataFrame, n: int | None = None, n_folds: int = 5, embargo: float = 0.01) -> DataFrame:
    """(fold, ...): the rows that a fold doesn't train on, about one copy of each row in all folds together."""
    return _with_roles(rows, n, n_folds, embargo).where("role is null or role = 'test'").drop("role")


def _with_roles(rows: DataFrame, n: int | None, n_folds: int, embargo: float) -> DataFrame:
    rows, fold = _counted(rows, n, n_folds, embargo)
    spans = rows.groupBy(fold.alias("fold")).agg(F.min("label_start").alias("_s"), F.max("label_end").alias("_e"), F.min("row").alias("_lo"), F.max("row").alias("_hi"))
    paired = rows.crossJoin(F.broadcast(spans))
    test = (F.col("row") >= F.col("_lo")) & (F.col("row") <= F.col("_hi"))
    clear = (F.col("label_end") < F.col("_s")) | (F.col("label_start") > F.col("_e"))
    after = (F.col("row") > F.col("_hi")) & (F.col("row") <= F.col("_hi") + F.col("_skip"))
    return paired.withColumn("role", F.when(test, "test").when(clear & ~after, "train")).drop("_s", "_e", "_lo", "_hi", "_skip", "n_rows")


def combinatorial_paths(rows: DataFrame, n: int | None = None, n_groups: int = 6, n_test: int = 2, embargo: float = 0.01) -> DataFrame:
    """(path, role, ...): every choice of ``n_test`` of ``n_groups`` stretches as the test set, purged per stretch."""
    rows, group = _counted(rows, n, n_groups, embargo)
    grouped = rows.withColumn("group", group)
    spans = grouped.groupBy(F.col("group").alias("g")).agg(F.min("label_start").alias("s"), F.max("label_end").alias("e"), F.max("row").alias("hi"))
    bounds = spans.agg(F.map_from_entries(F.collect_list(F.struct("g", F.struct("s", "e", "hi")))).alias("spans"))
    paths = F.array(*[F.struct(F.lit(i).alias("path"), F.array(*map(F.lit, c)).alias("test")) for i, c in enumerate(combinations(range(n_groups), n_test))])
    each = grouped.crossJoin(F.broadcast(bounds)).withColumn("p", F.explode(paths))
    blocked = F.expr("exists(p.test, g -> (label_start <= spans[g].e and spans[g].s <= label_end) or (row > spans[g].hi and row <= spans[g].hi + _skip))")
    role = F.when(F.expr("array_contains(p.test, group)"), "test").when(~blocked, "train")
    return each.withColumns({"path": F.col("p.path"), "role": role}).where("role is not null").drop("p", "spans", "group", "_skip", "n_rows")


# Combinatorially symmetric cross-validation.


def moment_sharpe(total: Column, squares: Column, n: Column, ppy: int) -> Column:
    """Annual Sharpe ratio from sums."""
    mean = total / F.nullif(n, F.lit(0))
    variance = (squares - n * mean * mean) / F.nullif(n - 1, F.lit(0))
    sd = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return F.coalesce(F.when(sd >= metrics.FLAT, mean / sd * math.sqrt(ppy)), F.lit(0.0))


def check_blocks(n_blocks: int) -> int:
    if n_blocks < 4 or n_blocks % 2 or (n := math.comb(n_blocks, n_blocks // 2)) > MAX_COMBINATIONS:
        raise ValueError(f"blocks must be even, at least 4 and give at most {MAX_COMBINATIONS} combinations")
    return n


def block_moments(returns: DataFrame, n_bars: int, n_blocks: int = 8) -> DataFrame:
    """(config, block, total, squares, n) of returns (config, seq from 1, ret); the ragged tail is dropped."""
    length = n_bars // n_blocks
    block = F.floor((F.col("seq") - 1) / F.lit(length)).cast("int")
    return returns.where(F.col("seq") <= length * n_blocks).groupBy("config", block.alias("block")).agg(
        F.sum("ret").alias("total"), F.sum(F.col("ret") * F.col("ret")).alias("squares"), F.count("ret").cast("double").alias("n")
    )


def cscv_logits(blocks: DataFrame, n_blocks: int = 8, ppy: int = 252) -> DataFrame:
    """(combo, config, is_sharpe, oos_sharpe, rel, logit) of the best configuration of each choice of blocks.

    A combination is a bit mask; its sums come from joining masks to block moments, so the returns are
    read once however many combinations there are.
    """
    check_blocks(n_blocks)
    masks = blocks.sparkSession.range(2**n_blocks).where(F.bit_count("id") == n_blocks // 2).select(F.col("id").cast("int").alias("combo"))
    inside = F.expr("(combo >> block) & 1") == 1
    each = blocks.crossJoin(F.broadcast(masks))
    part = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    sums = each.groupBy("combo", "config").agg(
        moment_sharpe(part(inside, "total"), part(inside, "squares"), part(inside, "n"), ppy).alias("is_sharpe"),
        moment_sharpe(part(~inside, "total"), part(~inside, "squares"), part(~inside, "n"), ppy).alias("oos_sharpe"),
    )
    of = Window.partitionBy("combo")
    rank = F.rank().over(of.orderBy("oos_sharpe")) + (F.count(F.lit(1)).over(Window.partitionBy("combo", "oos_sharpe")) - 1) / 2.0
    ranked = sums.select("*", (rank / (F.count(F.lit(1)).over(of) + 1)).alias("rel"), F.row_number().over(of.orderBy(F.desc("is_sharpe"), "config")).alias("_k"))
    best = ranked.where("_k = 1").withColumn("rel", F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("rel")))).drop("_k")
    return best.withColumn("logit", F.ln(F.col("rel") / (1 - F.col("rel"))))


def pbo(logits: DataFrame) -> DataFrame:
    """(n_combinations, pbo, prob_oos_loss, slope)."""
    wide = F.max("is_sharpe") - F.min("is_sharpe") > 1e-9
    slope = F.try_divide(F.covar_pop("is_sharpe", "oos_sharpe"), F.var_pop("is_sharpe"))
    return logits.agg(
        F.count(F.lit(1)).alias("n_combinations"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"),
        F.avg((F.col("oos_sharpe") < 0).cast("double")).alias("prob_oos_loss"), F.when(wide, slope).alias("slope"),
    )


def logit_histogram(logits: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n): equal bins from the least to the greatest logit, the last one closed; empty bins are left out."""
    whole = Window.partitionBy(F.lit(0))
    low, high = F.min("logit").over(whole), F.max("logit").over(whole)
    bounded = logits.select("logit", low.alias("lo"), high.alias("hi")).withColumns({"lo": F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5), "hi": F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5)})
    at = F.floor((F.col("logit") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int")
    return bounded.groupBy(F.least(F.lit(bins - 1), at).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pbo_summary(logits: DataFrame, n_strategies: int, bins: int = 20) -> dict:
    """The search's overfitting in one document, under the response's keys; two small jobs over a row a combination."""
    row = logits.agg(F.count(F.lit(1)).alias("n"), F.median("oos_sharpe").alias("m")).first()
    out = pbo(logits).first().asDict()
    counts = {r["bin"]: r["n"] for r in logit_histogram(logits, bins).collect()}
    few = n_strategies < 2 or not row["n"]
    return {
        "pbo": out["pbo"], "n_strategies": n_strategies, "n_combinations": out["n_combinations"], "median_oos_sharpe_selected": row["m"], "prob_oos_loss": out["prob_oos_loss"],
        "performance_degradation_slope": out["slope"], "histogram": [counts.get(b, 0) for b in range(bins)], "insufficient": few, "overfit": bool(out["pbo"] is not None and out["pbo"] > 0.5),
        "verdict": pbo_verdict(None if few else out["pbo"]), "note": "fewer than two configurations, or no combination" if few else "ok",
    }


def pbo_verdict(value: float | None) -> str:
    return "insufficient data" if value is None else "overfit" if value > 0.5 else "elevated" if value > 0.25 else "acceptable"


def grid_returns(panel: DataFrame, weights: dict[str, str], cost_bps: float = 5.0) -> DataFrame:
    """(config, seq, date, ret): a backtest per weight column, all in one plan."""
    keep = ["symbol", "date", "seq", "close"]
    long = panel.select(*keep, *[F.col(c).alias(k) for k, c in weights.items()]).unpivot(keep, list(weights), "config", "weight")
    return portfolio(positions(long, 1, ("config",)), cost_bps, ("config",)).select("config", "seq", "date", F.col("net").alias("ret"))
