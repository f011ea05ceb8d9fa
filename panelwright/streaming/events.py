"""Structured Streaming forms of windowed counts, de-duplication and admission control.

Each takes a streaming or a batch DataFrame; watermarks bound the state of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.parquet(path)


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", watermark) if events.isStreaming else timed


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows, or sliding ones with ``slide``."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = _timed(events, watermark).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """(user_id, start, finish, n): sessions end after a pause of ``gap``."""
    out = _timed(events, watermark).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def first_seen(events: DataFrame, keys: list[str], watermark: str = "1 day") -> DataFrame:
    """One row a key; a stream forgets keys after the watermark."""
    timed = _timed(events, watermark)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def admit(times: list, admitted: list, limit: int, period: float) -> tuple[list[bool], list]:
    """A sliding log: a hit passes if fewer than ``limit`` were admitted in the ``period`` before it; one without a time never does."""
    out = []
    for t in times:
        if t is None:
            out.append(False)
            continue
        admitted = [a for a in admitted if a > t - period]
        ok = len(admitted) < limit
        out.append(ok)
        if ok:
            admitted.append(t)
    return out, admitted


def rate_limited(events: DataFrame, limit: int = 10, period: float = 3600.0, key: str = "user_id", watermark: str = "1 hour") -> DataFrame:
    """(key, event_id, ts, admitted): whether each hit passes depends on those that passed before.

    A batch goes through a key's hits in order, row by row; a stream keeps them as state. Either holds at most ``limit``
    times a key. A stream drops hits later than the watermark, and forgets a key once none of its hits can count any more.
    """
    timed = _timed(events, watermark).select(key, "event_id", "ts", F.unix_micros("ts").alias("us"))
    schema = T.StructType([*timed.schema.fields[:3], T.StructField("admitted", T.BooleanType())])
    span = int(period * 1_000_000)

    if not events.isStreaming:

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, log = object(), []
            for batch in batches:
                out = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if k != last:
                        last, log = k, []
                    (ok,), log = admit([t], log, limit, span)
                    out.append(ok)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.bool_())], [key, "event_id", "ts", "admitted"])

        return timed.repartition(key).sortWithinPartitions(key, "ts", "event_id").mapInArrow(judge, schema)

    def step(_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        times = [None if pd.isna(t) else int(t) for t in rows["us"]]
        ok, kept = admit(times, list(state.get[0]) if state.exists else [], limit, span)
        if kept:
            state.update((kept,))
            state.setTimeoutTimestamp(max((max(kept) + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(admitted=ok)[[key, "event_id", "ts", "admitted"]]

    return timed.groupBy(key).applyInPandasWithState(step, schema, "admitted array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
