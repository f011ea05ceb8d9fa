"""Checks and helpers on plans: look-ahead in signals, padded date ranges, views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def looks_ahead(df: DataFrame) -> list[str]:
    """Window expressions over a symbol's time that read later rows: ``lead``, negative lags and frames past the current row.

    Cross-sections of a date are no time windows and may read their whole partition.
    """
    plan = df._jdf.queryExecution().analyzed().toString()
    found = []
    for m in re.finditer(r"(\w+)\(([^\n]{0,300}?)\) windowspecdefinition\(symbol#\d+(?:, [^\n]*?)?specifiedwindowframe\((?:RowFrame|RangeFrame), ([^,]+), ([^)]+(?:\(\))?)\)\)", plan):
        name, upper = m[1], m[4].strip()
        ahead = name == "lead" or "unboundedfollowing" in upper or re.fullmatch(r"[1-9]\d*", upper) or (name == "lag" and re.search(r", -?\d+, ", m[2] + ", ") and re.fullmatch(r"[1-9]\d*", upper))
        if ahead:
            found.append(m[0][:120])
    return found


def require_no_lookahead(df: DataFrame) -> DataFrame:
    if found := looks_ahead(df):
        raise ValueError(f"a signal reads the future: {found[0]}")
    return df


def over_range(panel: DataFrame, compute: Callable[[DataFrame], DataFrame], first: int, last: int, pad: int) -> DataFrame:
    """``compute`` on bars first .. last, reading only ``pad`` bars before them.

    A filter on bars does not pass a time window by itself: the source is cut to the padded range first.
    """
    return compute(panel.where(F.col("seq").between(first - pad, last))).where(F.col("seq").between(first, last))


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """The model's tables as temporary views for ``spark.sql``."""
    from ..sources import fixtures
    from . import catalogue

    views = {"prices": catalogue.priced, "obs": fixtures.observations, "pit": catalogue.fundamental, "scores": catalogue.scored, "portfolio": catalogue.folio}
    for name, make in views.items():
        make(spark, sf_dir).createOrReplaceTempView(name)
    return list(views)
