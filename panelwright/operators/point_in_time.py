"""Point-in-time placement: a value is visible from the first bar on or after it became known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol


def first_bar(known: DataFrame, calendar: DataFrame, date_col: str = "available_date") -> DataFrame:
    """``known`` with ``seq``, the first bar on or after its date; rows after the last bar are dropped.

    Distinct dates are merged with the calendar and looked up in one pass; both have as many rows as
    there are days, however many facts there are, so the lookup joins back as a small table.
    """
    bars = calendar.select(F.col("date").alias("day"), F.col("seq").cast("int").alias("seq"))
    asked = known.select(F.col(date_col).alias("day")).where("day is not null").distinct().withColumn("seq", F.lit(None).cast("int"))
    ahead = Window.orderBy("day", F.col("seq").isNull().desc()).rowsBetween(0, Window.unboundedFollowing)
    snapped = bars.unionByName(asked).select("day", F.col("seq").isNull().alias("asked"), F.first("seq", ignorenulls=True).over(ahead).alias("seq"))
    return known.join(snapped.where("asked and seq is not null").drop("asked"), F.col(date_col) == F.col("day")).drop("day")


def place(obs: DataFrame, panel: DataFrame, calendar: DataFrame, metrics: list[str], max_staleness: int = 400) -> DataFrame:
    """``panel`` with a column per metric: the value known on each bar, at most ``max_staleness`` bars old.

    Several facts on one bar: the latest known, then the latest period, wins. Symbols outside the panel are
    ignored. One aggregation and one window serve all metrics.
    """
    facts = first_bar(obs.where(F.col("metric").isin(metrics)), calendar)
    last = F.max_by("value", F.struct("available_date", "period_end", "value"))
    wide = facts.groupBy("symbol", "seq").pivot("metric", metrics).agg(last)
    frame = by_symbol().rowsBetween(-max_staleness, 0)
    placed = panel.join(wide, ["symbol", "seq"], "left")
    return placed.select(*panel.columns, *[F.last(m, ignorenulls=True).over(frame).alias(m) for m in metrics])


def bundle_metrics(obs: DataFrame) -> list[str]:
    """The metrics of an observation table, sorted (a bounded vocabulary)."""
    return [r[0] for r in obs.select("metric").distinct().orderBy("metric").collect()]


def place_scores(docs: DataFrame, panel: DataFrame, calendar: DataFrame, column: str, horizon: int = 63, order: str = "doc_id") -> DataFrame:
    """``panel`` with a text score held for ``horizon`` bars after its document, then 0.

    ``docs`` is (symbol, date, column, order); of several documents on a bar the last in ``order`` wins.
    """
    placed = first_bar(docs, calendar, "date").groupBy("symbol", "seq").agg(F.max_by(column, order).alias(column))
    frame = by_symbol().rowsBetween(-horizon, 0)
    return panel.join(placed, ["symbol", "seq"], "left").select(*panel.columns, F.coalesce(F.last(column, ignorenulls=True).over(frame), F.lit(0.0)).alias(column))


def label_end(panel: DataFrame, horizon: int) -> DataFrame:
    """``panel`` with the date ``horizon`` bars ahead, NULL in the tail."""
    return panel.withColumn("label_end", F.lead("date", horizon).over(by_symbol()))
