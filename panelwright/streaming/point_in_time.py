"""Point-in-time placement on a stream: each bar's value as it was known when the watermark passed the bar.

Bars and facts come in one stream, in any order. A (symbol, metric) keeps as state its open bars, the facts that are not
visible yet, and the fact that is; a bar is closed by a timer once the watermark has passed it, so facts that arrive late,
but within the watermark, still count on every open bar they belong to. What is kept is bounded by the watermark's delay
and by facts dated ahead: closed bars and replaced facts go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "symbol string, metric string, date date, seq int, value double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


def timeline(bars: DataFrame, facts: DataFrame, metrics: list[str]) -> DataFrame:
    """One stream (symbol, metric, at, seq, period_end, value) of bars (symbol, date, seq), once a metric, and facts (symbol, metric, available_date, period_end, value)."""
    none = lambda kind: F.lit(None).cast(kind)
    each = bars.select("symbol", F.explode(F.array(*map(F.lit, metrics))).alias("metric"), F.col("date").cast("timestamp").alias("at"), F.col("seq").cast("int").alias("seq"), none("date").alias("period_end"), none("double").alias("value"))
    known = facts.where(F.col("metric").isin(metrics)).select("symbol", "metric", F.col("available_date").cast("timestamp").alias("at"), none("int").alias("seq"), F.col("period_end").cast("date").alias("period_end"), F.col("value").cast("double").alias("value"))
    return each.unionByName(known)


class _Placement(StatefulProcessor):
    """Times are days since 1970; a missing value of a fact is a fact."""

    def __init__(self, max_staleness: int):
        self.max_staleness = max_staleness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "day int", "seq int")
        self.facts = handle.getListState("facts", "day int, period int, value double")
        self.shown = handle.getValueState("shown", "seq int, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            days = (part["at"].astype("int64") // _unit(part["at"]) // 86_400).tolist()
            periods = [None if pd.isna(p) else (pd.Timestamp(p) - pd.Timestamp(0)).days for p in part["period_end"]]
            for day, seq, period, value in zip(days, part["seq"].tolist(), periods, part["value"].tolist(), strict=True):
                if pd.isna(seq):
                    self.facts.appendValue((day, period, None if pd.isna(value) else float(value)))
                else:
                    self.bars.updateValue((day,), (int(seq),))
                    self.handle.registerTimer(day * DAY)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY
        (seq,) = self.bars.getValue((day,))
        self.bars.removeKey((day,))
        held = list(self.facts.get())
        new = [f for f in held if f[0] <= day]
        if new:
            best = max(new, key=lambda f: (f[0], f[1] is not None, f[1] or 0, f[2] is not None, f[2] or 0.0))
            if best[2] is not None:  # as in the batch form, a fact without a value leaves the one before it
                self.shown.update((seq, best[2]))
            ahead = [f for f in held if f[0] > day]
            self.facts.put(ahead) if ahead else self.facts.clear()
        value = None
        if self.shown.exists():
            placed, value = self.shown.get()
            if seq - placed > self.max_staleness:
                self.shown.clear()
                value = None
        yield pd.DataFrame({"symbol": [key[0]], "metric": [key[1]], "date": [pd.Timestamp(day * DAY, unit="ms").date()], "seq": [seq], "value": pd.Series([value], dtype="float64")})

    def close(self) -> None:
        pass


def _unit(times: pd.Series) -> int:
    """How many of a column's units a second has."""
    return {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}[str(times.dtype.unit) if hasattr(times.dtype, "unit") else "ns"]


def place_stream(rows: DataFrame, max_staleness: int = 400, delay: str = "7 days") -> DataFrame:
    """(symbol, metric, date, seq, value) of each bar of a ``timeline`` stream, once the watermark (``delay`` behind the newest row) has passed it.

    The session's state store must be RocksDB (``PROVIDER``). Facts later than the watermark are dropped by it.
    """
    timed = rows.withWatermark("at", delay)
    return timed.groupBy("symbol", "metric").transformWithStateInPandas(_Placement(max_staleness), OUTPUT, "Append", "EventTime")
