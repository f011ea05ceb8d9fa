"""Column builders. Missing is NULL, never NaN, and never zero unless a function says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-9
#: Denominators of at most this size give NULL.
TINY = 1e-12


def by_symbol() -> WindowSpec:
    """Rows of a symbol in time order."""
    return Window.partitionBy("symbol").orderBy("seq")


def by_date() -> WindowSpec:
    """The cross-section of a date."""
    return Window.partitionBy("date")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NULL instead of NaN and infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def safe_div(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL where the denominator is missing or tiny.

    Panels hold finite values or NULL (``finite`` at ingest), so the result is finite too; testing it here
    would triple every window expression inside.
    """
    num, den = col(num), col(den)
    return F.when(F.abs(den) > TINY, num / den)


def avg2(a: Column | str, b: Column | str) -> Column:
    """Mean of two, of the one there is, or NULL."""
    a, b = col(a), col(b)
    return F.coalesce((a + b) / 2, a, b)


def delta(now: Column | str, before: Column | str) -> Column:
    return col(now) - col(before)


def binary(condition: Column) -> Column:
    """1, 0, or NULL where the condition is unknown."""
    return condition.cast("double")


def clip(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL (``greatest`` and ``least`` alone skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def zscore(c: Column | str, window: WindowSpec | None = None, limit: float = 3.0) -> Column:
    """Cross-sectional z-score, clipped; a constant cross-section gives 0."""
    c, w = col(c), window or by_date()
    return clip((c - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + F.lit(EPS)), -limit, limit)


def blend(*scores: Column) -> Column:
    """Equal-weight mean with NULL read as 0; never NULL."""
    if not scores:
        raise ValueError("blend needs at least one score")
    return reduce(lambda a, b: a + b, (F.coalesce(s, F.lit(0.0)) for s in scores)) / len(scores)


def zsum(*scores: Column) -> Column:
    """Sum with NULL read as 0, NULL where all are NULL."""
    total = reduce(lambda a, b: a + b, (F.coalesce(s, F.lit(0.0)) for s in scores))
    return F.when(F.coalesce(*scores).isNotNull(), total)


def zprod(a: Column, b: Column) -> Column:
    return a * b


def lag(c: Column | str, n: int, window: WindowSpec | None = None) -> Column:
    return F.lag(col(c), n).over(window or by_symbol())


def change(c: Column | str, n: int = 1, window: WindowSpec | None = None) -> Column:
    """Relative change over n rows of the dense grid; NULL where either end is missing."""
    return safe_div(c, lag(c, n, window)) - 1


def forward_return(c: Column | str, horizon: int, window: WindowSpec | None = None) -> Column:
    """A label: looks ahead on purpose."""
    return safe_div(F.lead(col(c), horizon).over(window or by_symbol()), c) - 1


def rolling(aggregate, c: Column, rows: int, least: int, window: WindowSpec | None = None) -> Column:
    """An aggregate over the last ``rows`` rows, NULL with fewer than ``least`` values."""
    frame = (window or by_symbol()).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(c).over(frame) >= least, aggregate(c).over(frame))


def average_rank(c: Column | str, *partition: str) -> Column:
    """Rank from 1 with ties averaged; rows with a NULL must be filtered out before.

    Values equal to twelve decimals tie, so that ranks don't hang on the order in which doubles were summed.
    """
    c = F.round(col(c), 12)
    return F.rank().over(Window.partitionBy(*partition).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, c)) - 1) / 2.0


def quantile_bucket(rank: Column, size: Column, buckets: int) -> Column:
    """Bucket 0 .. buckets - 1 of the rank-th of ``size`` values, cut at interpolated quantiles of the ranks."""
    return F.greatest(F.lit(0), F.ceil((rank - 1) * buckets / F.when(size > 1, size - 1)) - 1).cast("int")


def correlation(x: Column, y: Column) -> Column:
    """An aggregate: Pearson correlation by moments, NULL where either side is constant.

    Sides are centred first by ``covar_pop`` and ``stddev_pop``, so that large means do not cancel.
    """
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > TINY, F.covar_pop(x, y) / spread)


def r6(c: Column | str) -> Column:
    """Rounded for comparison between engines, -0.0 as 0.0."""
    return F.round(col(c), 6) + F.lit(0.0)
