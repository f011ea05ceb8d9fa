"""How well a score ranks what comes after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import average_rank, by_symbol, correlation, forward_return, lag, quantile_bucket


def with_forward(panel: DataFrame, horizon: int = 1) -> DataFrame:
    return panel.withColumn("fwd", forward_return("close", horizon))


def ic_series(panel: DataFrame, score: str = "score", horizon: int = 1, method: str = "spearman", min_names: int = 5) -> DataFrame:
    """(date, seq, ic, n): correlation of score and forward return over the names that have both.

    Dates with fewer names or a constant side are left out.
    """
    known = with_forward(panel, horizon).where(F.col(score).isNotNull() & F.col("fwd").isNotNull())
    if method == "spearman":
        x, y = average_rank(score, "date"), average_rank("fwd", "date")
    elif method == "pearson":
        x, y = F.col(score), F.col("fwd")
    else:
        raise ValueError(f"unknown method {method!r}")
    ranked = known.select("date", "seq", x.alias("_x"), y.alias("_y"))
    out = ranked.groupBy("date", "seq").agg(correlation(F.col("_x"), F.col("_y")).alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= min_names) & F.col("ic").isNotNull())


def ic_summary(ic: DataFrame) -> DataFrame:
    """(n, mean_ic, std_ic, ir, t_stat, hit_rate); NULLs for fewer than three dates."""
    mean, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    ok = n >= 3
    return ic.agg(
        n.alias("n"), F.when(ok, mean).alias("mean_ic"), F.when(ok, sd).alias("std_ic"), F.when(ok, F.try_divide(mean, sd)).alias("ir"),
        F.when(ok, F.try_divide(mean, sd) * F.sqrt(n)).alias("t_stat"), F.when(ok, F.avg((F.round("ic", 12) > 0).cast("double"))).alias("hit_rate"),
    )


def ic_decay(panel: DataFrame, score: str = "score", horizons: tuple[int, ...] = (1, 5, 10, 21, 63)) -> DataFrame:
    """(horizon, mean_ic, n): all horizons' forward returns from one symbol window, then one pass by date."""
    ahead = panel.select("date", "seq", F.col(score).alias("_s"), *[forward_return("close", h).alias(f"h{h}") for h in horizons])
    long = ahead.unpivot(["date", "seq", "_s"], [f"h{h}" for h in horizons], "h", "fwd").where("_s is not null and fwd is not null")
    long = long.withColumn("horizon", F.substring("h", 2, 9).cast("int"))
    ranked = long.select("horizon", "date", average_rank("_s", "horizon", "date").alias("_x"), average_rank("fwd", "horizon", "date").alias("_y"))
    ic = ranked.groupBy("horizon", "date").agg(correlation(F.col("_x"), F.col("_y")).alias("ic"), F.count(F.lit(1)).alias("k")).where("k >= 5 and ic is not null")
    return ic.groupBy("horizon").agg(F.when(F.count("ic") >= 3, F.avg("ic")).alias("mean_ic"), F.count("ic").alias("n"))


def quantile_returns(panel: DataFrame, score: str = "score", buckets: int = 5, horizon: int = 1) -> DataFrame:
    """(bucket, mean_fwd, n_dates): mean forward return by equal-count bucket of the score, averaged over dates.

    Ties are broken by symbol position; dates with fewer than two names a bucket are left out.
    """
    known = with_forward(panel, horizon).where(F.col(score).isNotNull() & F.col("fwd").isNotNull())
    rank = F.row_number().over(Window.partitionBy("date").orderBy(score, "sym_pos"))
    ranked = known.select("date", "fwd", rank.alias("_r"), F.count(F.lit(1)).over(Window.partitionBy("date")).alias("_m")).where(F.col("_m") >= 2 * buckets)
    by_date = ranked.groupBy("date", quantile_bucket(F.col("_r"), F.col("_m"), buckets).alias("bucket")).agg(F.avg("fwd").alias("m"))
    return by_date.groupBy("bucket").agg(F.avg("m").alias("mean_fwd"), F.count("m").alias("n_dates"))


def quantile_spread(by_bucket: DataFrame) -> DataFrame:
    """(top_minus_bottom, monotone) of ``quantile_returns``."""
    step = F.col("mean_fwd") - F.lag("mean_fwd").over(Window.partitionBy(F.lit(0)).orderBy("bucket"))
    return by_bucket.withColumn("_step", step).agg(
        (F.max_by("mean_fwd", "bucket") - F.min_by("mean_fwd", "bucket")).alias("top_minus_bottom"), F.coalesce(F.min("_step") >= 0, F.lit(False)).alias("monotone")
    )


def rank_autocorrelation(panel: DataFrame, score: str = "score", n: int = 1) -> DataFrame:
    """(autocorrelation, n_dates): mean correlation of a date's ranks with those ``n`` bars before."""
    ranked = panel.where(F.col(score).isNotNull()).withColumn("_rank", average_rank(score, "date")).select("symbol", "seq", "_rank")
    dense = panel.select("symbol", "seq", "date").join(ranked, ["symbol", "seq"], "left").withColumn("_before", lag("_rank", n, by_symbol()))
    both = dense.where("_rank is not null and _before is not null")
    per = both.groupBy("date").agg(correlation(F.col("_rank"), F.col("_before")).alias("c"), F.count(F.lit(1)).alias("k")).where("k >= 5 and c is not null")
    return per.agg(F.avg("c").alias("autocorrelation"), F.count("c").alias("n_dates"))


def coverage(panel: DataFrame, score: str = "score") -> DataFrame:
    per = panel.groupBy("date").agg(F.avg(F.col(score).isNotNull().cast("double")).alias("c"))
    return per.agg(F.avg("c").alias("coverage"))


def sign_stability(ic: DataFrame, windows: int = 6, least: int = 10) -> DataFrame:
    """(n, consistency, dominant_sign, stable): share of eras whose mean has the whole series' sign.

    NULL verdicts for fewer than ``windows * least`` dates.
    """
    eras = ic.select("ic", F.ntile(windows).over(Window.partitionBy(F.lit(0)).orderBy("seq")).alias("era"), F.avg("ic").over(Window.partitionBy(F.lit(0))).alias("all"))
    means = eras.groupBy("era").agg(F.avg("ic").alias("m"), F.max("all").alias("all"), F.count(F.lit(1)).alias("k"))
    whole = means.agg(F.sum("k").alias("n"), F.signum(F.max("all")).alias("s0"), F.signum(F.avg("m")).alias("s1"), F.collect_list("m").alias("ms"))
    sign = F.when(F.col("s0") != 0, F.col("s0")).when(F.col("s1") != 0, F.col("s1")).otherwise(1.0)
    share = F.size(F.filter("ms", lambda m: F.signum(m) == F.col("sign"))) / F.size("ms")
    out = whole.withColumn("sign", sign).withColumn("share", share)
    ok = F.col("n") >= windows * least
    return out.select(
        "n", F.when(ok, F.col("share")).alias("consistency"), F.when(ok, F.col("sign").cast("int")).otherwise(0).alias("dominant_sign"), F.when(ok, F.col("share") >= 0.8).alias("stable")
    )


def extraction_stability(runs: DataFrame, item: str = "item", value: str = "value") -> DataFrame:
    """(mean_std, max_std, deterministic) of repeated extractions."""
    per = runs.groupBy(item).agg(F.stddev_pop(value).alias("s"))
    return per.agg(F.avg("s").alias("mean_std"), F.max("s").alias("max_std"), (F.max("s") < 1e-9).alias("deterministic"))


def scorecard(panel: DataFrame, score: str = "score", split: float = 0.7, horizons: tuple[int, ...] = (1, 5, 21)) -> dict:
    """IC, its halves in and out of sample, decay, buckets, coverage, persistence and a verdict on the rounded t."""
    ic = ic_series(panel, score).persist()
    try:
        whole = ic_summary(ic).first().asDict()
        last = panel.agg(F.max("seq")).first()[0] or 0
        cut = int(last * split)
        inside = ic_summary(ic.where(F.col("seq") <= cut)).first()["mean_ic"]
        outside = ic_summary(ic.where(F.col("seq") > cut)).first()["mean_ic"]
        stable = sign_stability(ic).first().asDict()
    finally:
        ic.unpersist()
    buckets = quantile_returns(panel, score)
    t = None if whole["t_stat"] is None else round(whole["t_stat"], 2)
    same = inside is not None and outside is not None and inside * outside > 0
    return {
        **whole, "t_stat": t, "in_sample_ic": inside, "out_sample_ic": outside, "ic_decay": {r["horizon"]: r["mean_ic"] for r in ic_decay(panel, score, horizons).collect()},
        "quantiles": [r["mean_fwd"] for r in buckets.orderBy("bucket").collect()], **quantile_spread(buckets).first().asDict(),
        **coverage(panel, score).first().asDict(), **rank_autocorrelation(panel, score).first().asDict(), "sign_stability": stable,
        "predictive": bool(t is not None and abs(t) > 2.0 and same and stable["stable"] is not False),
    }


def compact_scorecard(panel: DataFrame, score: str = "score", horizons: tuple[int, ...] = (1, 5, 21)) -> dict:
    """The short form for a response: IC, decay, coverage, persistence and the constancy of its sign, under the response's keys."""
    ic = ic_series(panel, score).persist()
    try:
        head, sign = ic_summary(ic).first().asDict(), sign_stability(ic).first().asDict()
    finally:
        ic.unpersist()
    t = None if head["t_stat"] is None else round(head["t_stat"], 2)
    verdict = "too few dates" if sign["stable"] is None else "keeps its sign" if sign["stable"] else "changes its sign"
    return {
        "mean_ic": head["mean_ic"], "ic_tstat": t, "ic_ir": head["ir"], "ic_hit_rate": head["hit_rate"], "ic_decay": {r["horizon"]: r["mean_ic"] for r in ic_decay(panel, score, horizons).collect()},
        "coverage": coverage(panel, score).first()[0], "rank_autocorr": rank_autocorrelation(panel, score).first()[0], "significant": bool(t is not None and abs(t) > 2.0),
        "ic_sign_consistency": sign["consistency"], "ic_sign_stable": sign["stable"], "ic_sign_verdict": verdict,
    }
