"""Placement on a stream equals the batch form, in whatever order rows arrive within the watermark."""

import datetime
import random

from pyspark.sql import functions as F

from panelwright.operators import point_in_time as pit
from panelwright.streaming import point_in_time as S

DAY = datetime.date(2020, 1, 6)


def test_replay_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    weeks = 30
    bars = [(s, DAY + datetime.timedelta(7 * k), k + 1) for s in "AB" for k in range(weeks)]
    facts = [
        (s, m, DAY + datetime.timedelta(d), DAY + datetime.timedelta(d - 40), None if rng.random() < 0.1 else float(rng.randrange(100)))
        for s in "AB" for m in ("x", "y", "other") for d in rng.sample(range(-20, 7 * weeks), 9)
    ]
    facts += [("A", "x", DAY + datetime.timedelta(21), DAY + datetime.timedelta(d), float(d)) for d in (1, 2)]  # two on one day
    b = spark.createDataFrame(bars, "symbol string, date date, seq int")
    f = spark.createDataFrame(facts, "symbol string, metric string, available_date date, period_end date, value double")
    line = S.timeline(b, f, ["x", "y"])
    calendar = b.select("date", "seq").distinct()
    placed = pit.place(f, b, calendar, ["x", "y"], 5).unpivot(["symbol", "date", "seq"], ["x", "y"], "metric", "value")
    want = {(r["symbol"], r["metric"], r["seq"]): r["value"] for r in placed.collect()}

    # Rows in blocks of three weeks, each block shuffled, and every third row one block late.
    rows = line.collect()
    origin = min(r["at"] for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault((r["at"] - origin).days // 21 + (rng.random() < 0.33), []).append(r)
    source = str(tmp_path / "in")
    spark.createDataFrame([], line.schema).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    stream = spark.readStream.schema(line.schema).parquet(source)
    end = [("Z", "x", max(r["at"] for r in rows) + datetime.timedelta(400), None, None, 0.0)]  # moves the watermark past the last bar
    try:
        for k, part in [*sorted(batches.items()), (99, end)]:
            rng.shuffle(part)
            spark.createDataFrame(part, line.schema).write.mode("append").parquet(source)
            query = S.place_stream(stream, 5, "70 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out")).where(F.col("symbol") != "Z").collect()
    assert len(got) == len(want) == 2 * 2 * weeks
    assert {(r["symbol"], r["metric"], r["seq"]): r["value"] for r in got} == want
