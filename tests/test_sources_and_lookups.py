"""Paged vendor tables, keyed lookups and stored answers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from panelwright.operators import keyed, text_signals
from panelwright.sources import observations, vendor_pages

NAMES = [("ticker", "String"), ("dimension", "String"), ("datekey", "Date"), ("reportperiod", "Date"), ("revenue", "Double"), ("netinc", "Integer")]


@pytest.fixture(scope="module")
def vendor(tmp_path_factory):
    """Six pages by ticker and date; the last one is broken, so reading it fails."""
    root = tmp_path_factory.mktemp("vendor")
    pages = []
    for k, (ticker, year) in enumerate([("AAA", 2019), ("AAA", 2020), ("BBB", 2019), ("BBB", 2020), ("CCC", 2020), ("ZZZ", 2020)]):
        rows = [[ticker, d, f"{year}-0{m}-15", f"{year}-0{m - 1}-01", None if m == 2 else 10.0 * m, m] for m in (2, 5, 8) for d in ("ARQ", "MRQ")]
        (root / f"p{k}.json").write_text("broken" if ticker == "ZZZ" else json.dumps({"columns": [{"name": n, "type": t} for n, t in NAMES], "data": rows}))
        pages.append({"file": f"p{k}.json", "ticker_min": ticker, "ticker_max": ticker, "datekey_min": f"{year}-02-15", "datekey_max": f"{year}-08-15"})
    (root / "index.json").write_text(json.dumps({"pages": pages}))
    return f"file://{root}"


def test_filters_choose_pages(spark, vendor):
    vendor_pages.register(spark)
    sf1 = spark.read.format("vendor_pages").option("root", vendor).load()
    some = sf1.where("ticker in ('AAA', 'BBB') and dimension = 'ARQ' and datekey >= date '2020-03-01'")
    rows = some.orderBy("ticker", "datekey").collect()
    assert [(r["ticker"], str(r["datekey"]), r["revenue"], r["netinc"]) for r in rows] == [(t, f"2020-0{m}-15", 10.0 * m, float(m)) for t in ("AAA", "BBB") for m in (5, 8)]
    assert some.rdd.getNumPartitions() == 2  # of six pages, the broken one among those left
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ticker" in plan and "Filter (" not in plan  # all filters are the source's
    with pytest.raises(Exception, match="JSONDecodeError"):
        sf1.where("ticker = 'ZZZ'").collect()
    assert sf1.where("ticker = 'none'").count() == 0
    odd = sf1.where("ticker in ('AAA', 'BBB') and (revenue is null or netinc > 6) and length(dimension) = 3").count()
    assert odd == 4 * 2 * 2  # filters that the source doesn't take are Spark's


def test_vendor_pages_as_observations(spark, vendor):
    vendor_pages.register(spark)
    sf1 = spark.read.format("vendor_pages").option("root", vendor).load()
    obs = observations.sharadar(sf1, ["aaa"], start="2020-01-01").collect()
    assert {r["symbol"] for r in obs} == {"AAA"} and {r["metric"] for r in obs} == {"revenue", "net_income"} and all(str(r["available_date"]) >= "2020" for r in obs)


def test_simfin_takes_tickers_in_any_case(spark):
    income = spark.createDataFrame([("aapl", "2020-01-01", "2020-02-01", 1.0), ("AAPL", "2020-04-01", "2020-05-01", 2.0), ("msft", "2020-01-01", "2020-02-01", 3.0)], "Ticker string, `Report Date` string, `Publish Date` string, Revenue double")
    none = income.where("false").drop("Revenue")
    obs = observations.simfin(income, none.withColumn("Total Assets", F.lit(1.0)), none.withColumn("Net Cash from Operating Activities", F.lit(1.0)), ["aapl"])
    assert sorted(r["value"] for r in obs.where("metric = 'revenue'").collect()) == [1.0, 2.0] and {r["symbol"] for r in obs.collect()} == {"AAPL"}


def test_lookups_read_one_bucket(spark, tmp_path):
    path, schema = str(tmp_path / "keyed"), "id string, n long, note string"
    rows = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), F.col("id").alias("n"), F.lit("x").alias("note"))
    keyed.write_keyed(rows, path, ["id"], 16, ("n",))
    found = keyed.lookup(spark, path, schema, 16, id="k77")
    assert [tuple(r) for r in found.collect()] == [("k77", 77, "x")]
    assert len(found.inputFiles()) > 1 and sum(len([f for f in fs if f.endswith(".parquet")]) for _, _, fs in os.walk(path)) == 16
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "EqualTo(id,k77)" in plan
    metrics = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    assert metrics.apply("numFiles").value() == 1
    assert keyed.lookup(spark, path, schema, 16, id="none").count() == 0
    asked = spark.createDataFrame([("k1",), ("k2",), ("k2",), ("none",), (None,)], "id string")
    assert sorted(r["n"] for r in keyed.lookup_many(spark, path, schema, asked, ["id"], 16).collect()) == [1, 2]


def test_answers_are_asked_for_once(spark, tmp_path):
    log, cache = str(tmp_path / "asked"), text_signals.AnswerCache(spark, str(tmp_path / "cache"))
    os.makedirs(log)

    def answer(text):
        with open(f"{log}/{abs(hash(text))}", "a") as f:
            f.write("x")
        return '{"guidance_change": 0.5, "tone": -0.5, "reason": "%s"}' % text[:3]

    source = str(tmp_path / "in")
    docs = lambda *ts: spark.createDataFrame([(t,) for t in ts], "text string")
    docs("one", "two", "two").write.parquet(source)
    stream, seen, failing = spark.readStream.schema("text string").parquet(source), {}, [True]

    def then(df, number):
        rows = [r["signal"]["reason"] for r in df.collect()]
        if failing[0]:
            raise RuntimeError("after the answers were stored")
        seen.setdefault(number, []).extend(rows)

    def run():
        cache.follow(stream, answer, then, str(tmp_path / "state")).awaitTermination(120)

    with pytest.raises(Exception, match="after the answers"):
        run()
    failing[0] = False
    run()
    docs("two", "three").write.mode("append").parquet(source)
    run()
    assert {n: sorted(r) for n, r in seen.items()} == {0: ["one", "two", "two"], 1: ["thr", "two"]}
    assert sorted(open(f"{log}/{f}").read() for f in os.listdir(log)) == ["x"] * 3  # each text once
    assert cache.read().count() == 3
    whole = text_signals.answers_to_misses(docs("y" * 20_000), lambda t: str(len(t)), None, shown_chars=None).first()["raw"]
    assert whole == "20000" and text_signals.answers_to_misses(docs("y" * 20_000), lambda t: str(len(t)), None).first()["raw"] == "12000"
