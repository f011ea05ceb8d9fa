"""As-of joins without a calendar, split by time so that one busy key is many tasks' work.

A key's history is cut into ranges of a fixed width. Within a range one window carries the last right row forward; across
ranges only one row a range is carried (its last right row). So a key that holds a third of all rows costs
as many tasks as it has ranges, and what a single task orders beyond a range is one row per range of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _span(interval: str) -> Column:
    """An interval such as "1 day" in microseconds."""
    return F.expr(f"unix_micros(timestamp '2000-01-01 00:00:00' + interval {interval}) - unix_micros(timestamp '2000-01-01 00:00:00')")


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str | None = None, values: list[str] | None = None, order: list[str] | None = None,
    width: str = "1 day", tolerance: str | None = None, prefix: str = "right_",
) -> DataFrame:
    """``left`` with the time and ``values`` of the last right row of the same key at or before its time, null where there is none.

    Of right rows at one time the last by ``order`` counts. With a ``tolerance`` older rows don't count. Null keys and times
    match nothing. ``values`` are all right columns but the key and the time where not given; all come out under ``prefix``.
    """
    right_time = right_time or time
    values = [c for c in right.columns if c not in (*by, right_time)] if values is None else values
    span = _span(width)
    keys = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    seen = F.struct(F.col(f"`{right_time}`").alias("t"), *[F.col(f"`{c}`") for c in values])
    ties = F.struct(*[F.col(f"`{c}`") for c in order]) if order else F.lit(0)
    facts = right.select(*keys, _micros(F.col(f"`{right_time}`")).alias("_at"), ties.alias("_tie"), seen.alias("_seen")).where("_at is not null")
    facts = facts.withColumn("_range", F.floor(F.col("_at") / span))
    asked = left.select(*keys, F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), _micros(F.col(f"`{time}`")).alias("_at"))
    asked = asked.withColumn("_range", F.floor(F.col("_at") / span))

    last = facts.groupBy(*names, "_range").agg(F.max_by("_seen", F.struct("_at", "_tie")).alias("_last"))
    ranges = asked.select(*names, "_range").distinct().join(last, [*names, "_range"], "full")
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(*[F.col(n).alias(f"c{n}") for n in names], F.col("_range").alias("c_range"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))

    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = asked.select(*names, "_range", "_at", F.lit(1).alias("_side"), none(facts, "_tie"), "_row", none(facts, "_seen")).unionByName(
        facts.select(*names, "_range", "_at", F.lit(0).alias("_side"), "_tie", none(asked, "_row"), "_seen")
    )
    upto = Window.partitionBy(*names, "_range").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_found", F.last("_seen", ignorenulls=True).over(upto)).where("_side = 1")
    same = F.col("_range").eqNullSafe(F.col("c_range"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"c{n}"))
    joined = filled.join(carried, same, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    known = F.col("_at").isNotNull()
    for n in names:
        known = known & F.col(n).isNotNull()
    if tolerance:
        known = known & (_micros(F.col("_found.t")) + _span(tolerance) >= F.col("_at"))
    found = F.when(known, F.col("_found"))
    return joined.withColumn("_found", found).select("_row.*", F.col("_found.t").alias(f"{prefix}{right_time}"), *[F.col("_found").getField(c).alias(f"{prefix}{c}") for c in values])


def epochs(events: DataFrame, cuts: DataFrame, by: list[str], time: str, order: str, width: str = "1 day") -> DataFrame:
    """``events`` with ``epoch``: the ``order`` value of the last cut before it, null before the first."""
    return asof_join(events, cuts, by, time, values=[order], order=[order], width=width, prefix="_cut_").withColumnRenamed(f"_cut_{order}", "epoch").drop(f"_cut_{time}")
