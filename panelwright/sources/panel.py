"""From long observations to dense symbol-by-date panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, finite


def calendar_of(dates: DataFrame, step: str = "interval 7 days") -> DataFrame:
    """(date, seq from 1): every ``step`` from the first to the last date in ``dates`` (one row of bounds is gathered)."""
    bounds = dates.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = bounds.select(F.posexplode(F.expr(f"sequence(lo, hi, {step})")).alias("pos", "date"))
    return days.select("date", (F.col("pos") + 1).alias("seq"))


def trading_calendar(dates: DataFrame) -> DataFrame:
    """(date, seq from 1): the distinct dates themselves, for calendars with holes."""
    days = dates.select("date").distinct()
    return days.select("date", F.row_number().over(Window.orderBy("date")).alias("seq"))


def densify(values: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row for each symbol and calendar date, left-joined to ``values`` (symbol, date, ...), doubles finite or NULL; adds sym_pos.

    The calendar is one array of as many entries as there are dates, sent to every symbol; the grid is
    made by exploding it, so symbols stay partitioned and nothing is crossed by a join of two tables.
    """
    days = calendar.agg(F.array_sort(F.collect_list(F.struct("seq", "date"))).alias("days"))
    symbols = values.select("symbol").distinct()
    positions = symbols.select("symbol", F.row_number().over(Window.orderBy("symbol")).alias("sym_pos"))
    grid = positions.crossJoin(F.broadcast(days)).select("symbol", "sym_pos", F.explode("days").alias("day")).select("symbol", "sym_pos", "day.date", "day.seq")
    known = values.select(*[finite(c).alias(c) if kind == "double" else F.col(c) for c, kind in values.dtypes])
    return grid.join(known, ["symbol", "date"], "left")


def forward_fill(panel: DataFrame, *columns: str, limit: int | None = None) -> DataFrame:
    """Last known value of each column, at most ``limit`` rows old."""
    frame = by_symbol().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in columns})


def drop_empty_dates(panel: DataFrame, column: str = "close") -> DataFrame:
    """Only dates on which some symbol has a value."""
    seen = F.count(column).over(Window.partitionBy("date"))
    return panel.withColumn("_seen", seen).where("_seen > 0").drop("_seen")
