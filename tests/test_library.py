"""Hand-built cases, truncation invariance and degenerate inputs."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import expressions as X
from panelwright.functions import factors, normal
from panelwright.operators import asof, attribution, guards, metrics, models, out_of_sample, portfolio, signal_quality, store, text_signals
from panelwright.operators import point_in_time as pit
from panelwright.plans import catalogue, workflow
from panelwright.sources import fixtures, observations, panel, synthetic
from panelwright.streaming import events as streams

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2020, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


def series(spark, values, name="net"):
    return spark.createDataFrame([(day(i), i + 1, float(v)) for i, v in enumerate(values)], f"date date, seq int, {name} double")


def toy(spark):
    rows = [("A", 1, day(i), i + 1, c, w) for i, (c, w) in enumerate(zip((100.0, 110.0, 121.0, 121.0), (1.0, 1.0, 0.0, 0.0), strict=True))]
    return spark.createDataFrame(rows, "symbol string, sym_pos int, date date, seq int, close double, weight double")


def test_position_is_lagged(spark):
    held = portfolio.positions(toy(spark)).orderBy("seq").collect()
    assert [r["pos"] for r in held] == [0, 1, 1, 0]
    out = portfolio.backtest(toy(spark), cost_bps=0).orderBy("seq").collect()
    assert [round(r["net"], 9) for r in out] == [0, 0.1, 0.1, 0] and [round(r["equity"], 9) for r in out] == [1, 1.1, 1.21, 1.21]


def test_costs_reduce_equity_and_lag_is_required(spark):
    final = [portfolio.backtest(toy(spark), cost_bps=b).orderBy(F.desc("seq")).first()["equity"] for b in (0, 10, 100)]
    assert final[0] > final[1] > final[2]
    with pytest.raises(ValueError):
        portfolio.positions(toy(spark), execution_lag=0)


def test_staleness(spark):
    grid = spark.createDataFrame([(s, p, day(i), i + 1) for p, s in enumerate("AB") for i in range(60)], "symbol string, sym_pos int, date date, seq int")
    obs = spark.createDataFrame([("A", day(1), day(29), "roe", 0.15), ("Z", day(1), day(3), "roe", 9.0), ("A", day(1), day(400), "roe", 7.0)], observations.OBS_SCHEMA)
    out = pit.place(obs, grid, grid.select("date", "seq").distinct(), ["roe", "absent"], 10)
    seen = {(r["symbol"], r["seq"]): r["roe"] for r in out.collect()}
    assert all(seen["A", q] == (0.15 if 30 <= q <= 40 else None) for q in range(1, 61)) and all(seen["B", q] is None for q in range(1, 61))


def test_text_decays_to_zero(spark):
    grid = spark.createDataFrame([("A", 1, day(i), i + 1) for i in range(50)], "symbol string, sym_pos int, date date, seq int")
    docs = spark.createDataFrame([("A", day(19), 1, 0.5)], "symbol string, date date, doc_id int, tone double")
    out = {r["seq"]: r["tone"] for r in pit.place_scores(docs, grid, grid.select("date", "seq"), "tone", 10).collect()}
    assert all(out[q] == (0.5 if 20 <= q <= 30 else 0.0) for q in range(1, 51))


def test_row_expressions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    null = F.lit(None).cast("double")
    assert get(X.safe_div(F.lit(1.0), F.lit(0.0))) is None and get(X.safe_div(F.lit(5.0), F.lit(1e-15))) is None and get(X.safe_div(F.lit(6.0), F.lit(2.0))) == 3
    assert get(X.avg2(F.lit(2.0), null)) == 2 and get(X.avg2(F.lit(2.0), F.lit(4.0))) == 3 and get(X.avg2(null, null)) is None
    assert get(X.zsum(null, null)) is None and get(X.zsum(F.lit(1.0), null)) == 1 and get(X.blend(null, F.lit(1.0))) == 0.5
    assert get(X.clip(null, -3, 3)) is None and get(X.finite(F.lit(float("nan")))) is None
    with pytest.raises(ValueError):
        X.blend()


def test_drawdown_and_metrics(spark):
    curve = series(spark, (1, 0.9, 0.8, 1, 1.2, 1.1, 0.9), "equity")
    out = metrics.drawdown_stats(curve).first()
    assert round(out["max_drawdown"], 9) == -0.25 and (out["longest"], out["episodes"]) == (2, 2)
    flat = metrics.moments(series(spark, [0.01] * 100)).first()
    assert flat["sharpe"] == 0 and flat["skew"] is None
    spread = metrics.moments(series(spark, [1.0] * 10)).first()
    assert abs(spread["gain_hhi"]) < 1e-12
    assert metrics.moments(series(spark, [0.5])).first()["gain_hhi"] is None
    assert metrics.tail_risk(series(spark, range(19))).first()["var"] is None
    tails = metrics.tail_risk(series(spark, range(100))).first()
    assert tails["var"] == -4 and tails["cvar"] == -2
    assert metrics.moments(series(spark, [])).first()["n"] == 0


def test_distributions():
    assert abs(normal.t_two_sided(2.0, 10) - 0.073388035) < 1e-8
    assert metrics.expected_max_sharpe(1, 1.0) == 0 and metrics.expected_max_sharpe(100, 1.0) > metrics.expected_max_sharpe(10, 1.0)
    assert math.isnan(metrics.probabilistic_sharpe(0.1, 2, 0.0, 0.0)) and metrics.deflated_sharpe(0.1, 500, 0.0, 0.0, 1) > metrics.deflated_sharpe(0.1, 500, 0.0, 0.0, 50)


def test_perfect_signal(spark):
    p = fixtures.price_panel(spark, SF)
    known = p.withColumn("score", X.forward_return("close", 1))
    assert signal_quality.ic_summary(signal_quality.ic_series(known)).first()["mean_ic"] > 0.99
    late = known.withColumn("score", F.col("ret"))
    assert guards.lookahead(late).first()["suspicious"]


def test_extraction_stability(spark):
    rows = lambda v: spark.createDataFrame([(i, float(x)) for i, r in enumerate(v) for x in r], "item int, value double")
    assert signal_quality.extraction_stability(rows([[0.5] * 3, [-0.2] * 3])).first()["deterministic"]
    assert not signal_quality.extraction_stability(rows([[0.5, 0.4, 0.6]])).first()["deterministic"]


def test_simpson(spark):
    rows = [("X", i < 90, 0.6 if i < 90 else 0.5) for i in range(100)] + [("Y", i < 10, 0.95 if i < 10 else 0.9) for i in range(100)]
    out = guards.simpson(spark.createDataFrame(rows, "grp string, treat boolean, out double"), "grp", "treat", "out").first()
    assert out["signs_agree"] and out["reversed"] and out["n_groups"] == 2


def test_vendor_unpivot(spark):
    df = spark.createDataFrame(
        [("AAA", "2020-03-31", "2020-05-10", 10.0, float("nan"), 1), ("BBB", "2020-03-31", "2020-05-12", 7.0, 2.0, 1)],
        "Ticker string, `Report Date` string, `Publish Date` string, Revenue double, `Net Income` double, Irrelevant int",
    )
    out = observations.unpivot_vendor(df, observations.SIMFIN_INCOME, "Ticker", "Report Date", "Publish Date")
    assert {(r["symbol"], r["metric"], r["value"]) for r in out.collect()} == {("AAA", "revenue", 10.0), ("BBB", "revenue", 7.0), ("BBB", "net_income", 2.0)}
    with pytest.raises(KeyError):
        observations.unpivot_vendor(df, observations.SIMFIN_INCOME, "nope", "Report Date", "Publish Date")
    assert observations.unpivot_vendor(df, {"x": "absent"}, "Ticker", "Report Date", "Publish Date").count() == 0
    sf1 = spark.createDataFrame([("AAA", "ARQ", "2020-03-31", "2020-05-10", 5.0)], "ticker string, dimension string, reportperiod string, datekey string, assets double")
    assert observations.sharadar(sf1, ["aaa"]).first()["metric"] == "total_assets"
    for bad in (lambda: observations.sharadar(sf1, ["aaa"], "MRQ"), lambda: observations.provider("nope")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        observations.require_key("NO_SUCH_KEY_HERE", "the vendor")


def test_densify_and_price_file(spark, tmp_path):
    rows = [("A", day(0), 1.0, 5.0), ("A", day(2), float("nan"), 5.0), ("B", day(0), 2.0, 1.0), ("B", day(1), None, 1.0), ("B", day(3), 4.0, 1.0)]
    spark.createDataFrame(rows, "symbol string, date date, close double, volume double").write.parquet(str(tmp_path / "p"))
    out = {(r["symbol"], r["seq"]): r["close"] for r in observations.price_file(spark, str(tmp_path / "p")).collect()}
    assert len(out) == 8 and out["A", 3] == 1.0 and out["B", 2] == 2.0 and out["B", 4] == 4.0


@pytest.mark.parametrize("name", sorted({*factors.SIMPLE, *factors.COMPOSITE} - {n for n in factors.SIMPLE if n.startswith("ratio_")} - {"ratio_value_score", "ratio_quality_score", "value_quality_score"}))
def test_no_factor_looks_ahead(spark, name, wide):
    """Cutting the panel leaves the past as it was."""
    cut = 150
    whole = {(r["symbol"], r["seq"]): r[name] for r in factors.add_factors(wide, name, bars=factors.WEEKLY).where(F.col("seq") <= cut).select("symbol", "seq", name).collect()}
    part = {(r["symbol"], r["seq"]): r[name] for r in factors.add_factors(wide.where(F.col("seq") <= cut), name, bars=factors.WEEKLY).select("symbol", "seq", name).collect()}
    assert whole.keys() == part.keys() and len(whole) > 0
    assert all((a is None) == (part[k] is None) and (a is None or abs(a - part[k]) < 1e-9) for k, a in whole.items())


@pytest.fixture(scope="module")
def wide(spark):
    df = catalogue.fundamental(spark, SF).cache()
    yield df
    df.unpersist()


def test_unknown_names(spark, wide):
    for call in (lambda: factors.resolve("nope"), lambda: models.make_model("nope"), lambda: attribution.attribution(wide, wide, "nope"), lambda: signal_quality.ic_series(wide, "close", method="nope")):
        with pytest.raises(ValueError):
            call()


def test_missing_metric_is_null(spark):
    p = fixtures.price_panel(spark, SF)
    assert factors.add_factors(p, "roe", bars=factors.WEEKLY).where("roe is not null").count() == 0


def test_folds_and_combinations(spark):
    assert out_of_sample.check_blocks(8) == 70 and out_of_sample.check_blocks(16) == 12870
    for bad in (3, 7, 18):
        with pytest.raises(ValueError):
            out_of_sample.check_blocks(bad)
    rows = spark.createDataFrame([(i, i // 10, i // 10 + 2, day(i // 10), i % 10) for i in range(1000)], "row int, label_start int, label_end int, date date, sym_pos int")
    folds = out_of_sample.purged_folds(rows, 1000, 5, 0.02).collect()
    for k in range(5):
        test = [r for r in folds if r["fold"] == k and r["role"] == "test"]
        train = [r for r in folds if r["fold"] == k and r["role"] == "train"]
        lo, hi = min(r["label_start"] for r in test), max(r["label_end"] for r in test)
        assert len(test) == 200 and all(r["label_end"] < lo or r["label_start"] > hi for r in train)
    paths = out_of_sample.combinatorial_paths(rows, 1000, 6, 2)
    assert paths.select("path").distinct().count() == 15
    with pytest.raises(ValueError):
        out_of_sample.with_folds(toy(spark), 4, 5)


def test_noise_is_overfit(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    noise = [(f"c{m:02d}", t + 1, float(x)) for m in range(10) for t, x in enumerate(rng.normal(0, 0.01, 400))]
    edge = noise + [("edge", t + 1, float(x)) for t, x in enumerate(rng.normal(0.004, 0.01, 400))]
    value = lambda rows: out_of_sample.pbo(out_of_sample.cscv_logits(out_of_sample.block_moments(spark.createDataFrame(rows, "config string, seq int, ret double"), 400))).first()
    a, b = value(noise), value(edge)
    assert a["n_combinations"] == 70 and b["pbo"] < 0.05 < a["pbo"]


def test_attribution_recovers_betas(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    mkt = rng.normal(0, 0.01, 300)
    factor = spark.createDataFrame([(day(i), float(m)) for i, m in enumerate(mkt)], "date date, MKT double")
    strategy = series(spark, 0.8 * mkt + rng.normal(0, 1e-4, 300))
    fit = attribution.attribution(strategy, factor, "capm")
    assert abs(fit["betas"]["MKT"] - 0.8) < 0.01 and fit["verdict"] == "mostly beta"
    assert attribution.attribution(strategy, factor.limit(20), "carhart4")["insufficient"]


def test_ledger():
    base = {"provider": "synthetic", "factor": "momentum", "lookback": 126, "symbols": ["b", " A "], "seed": 1}
    same = [{**base, "lookback": "126"}, {**base, "lookback": 126.0}, {**base, "symbols": ["a", "B"]}, {**base, "n_trials": 99}]
    assert {guards.fingerprint(r) for r in same} == {guards.fingerprint(base)}
    assert guards.fingerprint({**base, "seed": 2}) != guards.fingerprint(base)
    assert guards.fingerprint({**base, "factor": " momentum "}) == guards.fingerprint(base) and guards.canonical_number(" x ") == "x"
    assert guards.canonical_symbols("a,b") == ["A,B"] and guards.canonical_symbols([None, " b", "a"]) == ["A", "B"] and guards.canonical_symbols(None) == []
    book = guards.TrialLedger()
    for k in (20, 40, 60, 80, 80):
        book.record({**base, "lookback": k})
    assert book.effective(1) == 4 and book.effective(10) == 10
    book.reset("again")
    assert book.distinct == 0 and book.resets[0]["runs"] == 5


def test_store(spark):
    e = spark.createDataFrame([(w, i, f"act{i}") for w in (1, 2) for i in range(5)], "workspace int, id int, body string")
    chained = store.chain(e, ["workspace"], ["id"], F.col("body"))
    assert all(r["valid"] for r in store.verify_chain(chained, ["workspace"], ["id"]).collect())
    bent = chained.withColumn("body", F.when((F.col("workspace") == 1) & (F.col("id") == 2), "forged").otherwise(F.col("body")))
    assert {r["workspace"]: r["valid"] for r in store.verify_chain(bent, ["workspace"], ["id"]).collect()} == {1: False, 2: True}
    part = store.chain(e.where("id < 3"), ["workspace"], ["id"], F.col("body"))
    rest = store.chain(e.where("id >= 3"), ["workspace"], ["id"], F.col("body"), after=part.where("id = 2"))
    assert sorted(part.union(rest).collect()) == sorted(chained.collect())
    import hashlib
    import hmac

    got = spark.range(1).select(store.blind_index(F.lit(" Me@X.org "), "key").alias("x")).first()["x"]
    assert got == hmac.new(b"key", b"me@x.org", hashlib.sha256).hexdigest()
    key = b"0123456789abcdef"
    assert spark.range(1).select(store.decrypt(store.encrypt(F.lit("s3cret"), key), key).alias("x")).first()["x"] == "s3cret"
    secret, digest = store.new_key()
    keys = spark.createDataFrame([("k1", "w1", digest, None, 1), ("k2", "w1", "x", None, 1), ("k2", "w1", "x", 5, 2)], "id string, workspace_id string, secret_sha string, revoked_at int, updated_at int")
    asked = spark.createDataFrame([(secret,), ("wrong",)], "secret string")
    assert [r["key_id"] for r in store.resolve_keys(asked, keys).collect()] == ["k1"] and store.active_keys(keys).count() == 1
    tables = {"memberships": spark.createDataFrame([("w1", "u1", "OWNER", 1, 1)], "workspace_id string, user_id string, role string, created_at int, updated_at int"), "users": spark.createDataFrame([("u1", b"e", 1)], "id string, email_enc binary, updated_at int"), "api_keys": keys, "runs": e.limit(0).withColumn("workspace_id", F.lit("w1")), "audit_log": e.limit(0).withColumn("workspace_id", F.lit("w1"))}
    assert "k1" in store.export_workspace("w1", tables).first()["api_keys"]
    revoked = store.revoke_keys(keys, ["k1"], F.lit(9))
    assert store.active_keys(keys.unionByName(revoked)).count() == 0 and store.by_key(keys, ["id"], id="k2").first()["revoked_at"] == 5
    _, member = store.create_workspace(spark.createDataFrame([("w2", 1, 1)], "id string, created_at int, updated_at int"), "u9")
    assert member.first()["role"] == "OWNER" and store.audited("me", "x", "w") == '{"action":"x","actor":"me","detail":{},"workspace_id":"w"}'
    kept, gone = store.erase_workspace("w1", tables)
    assert "api_keys" in store.tombstone("w1", gone).first()["body"] and "w1" not in store.tombstone("w1", gone).first()["body"]
    assert kept["memberships"].count() == 0 and {r["table"]: r["n"] for r in gone.collect()}["api_keys"] == 3


def test_text(spark):
    docs = spark.createDataFrame([(1, "Results were strong and robust, weak in part"), (2, None), (3, "nothing")], "doc_id int, text string")
    assert [round(r[0], 6) for r in docs.orderBy("doc_id").select(text_signals.keyword_tone("text")).collect()] == [0.333333, 0, 0]
    cache = docs.where("doc_id = 3").select(F.sha2("text", 256).alias("text_sha"), F.lit('{"guidance_change": 0, "tone": 0.5, "reason": "cached"}').alias("raw"))
    out = text_signals.extract(docs, lambda t: 'said {"guidance_change": 2, "tone": 0, "reason": "x"}', cache)
    got = {r["doc_id"]: (r["signal"]["reason"], r["ok"]) for r in out.withColumn("ok", text_signals.is_valid()).collect()}
    assert got == {1: ("x", False), 2: ("x", False), 3: ("cached", True)}


def test_streams(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    q = streams.windowed_counts(streams.read_events(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == e.count()
    batch = streams.rate_limited(e, 2, 86_400.0)
    assert batch.count() == e.count() and batch.where("admitted").count() < e.count()
    assert streams.admit([0, 1, 2, 11], [], 2, 10)[0] == [True, True, False, True]
    e.coalesce(1).write.parquet(str(tmp_path / "one"))
    q = streams.rate_limited(streams.read_events(spark, str(tmp_path / "one")), 2, 86_400.0).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("limited").where("admitted").count() == batch.where("admitted").count()
    q = streams.first_seen(streams.read_events(spark, str(tmp_path / "one")), ["user_id"]).writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == e.select("user_id").distinct().count()


def test_requests(spark):
    assert workflow.validate({})["lookback"] == 252
    for bad in ({"factor": "nope"}, {"provider": "nope"}, {"periods": 10}, {"lookback": 10, "skip": 10}, {"gross": 9}, {"start": "nope"}, {"cost_bps": "x"}, {"symbols": ["A"] * 51}):
        with pytest.raises(workflow.RequestError):
            workflow.validate(bad)
    assert workflow.effective_lookback("reversal", 252) == 63 and workflow.clean({"a": [float("nan"), 1.0]}) == {"a": [None, 1.0]}


def test_workflow_document(spark):
    doc = workflow.run_backtest(spark, {"factor": "reversal", "periods": 300, "lookback": 40, "skip": 0, "symbols": ["a", "b", "c", "d", "e", "f"]}, guards.TrialLedger())
    assert {"meta", "verdict", "scorecard", "signal_quality", "out_of_sample", "walk_forward", "pbo", "trial_audit", "attribution", "fat_tails", "equity_curve", "drawdown_curve"} <= doc.keys()
    assert doc["meta"]["n_bars"] == 300 and doc["pbo"]["n_combinations"] == 70


def test_planted_quality_is_found(spark):
    world = synthetic.synthetic_world(spark, [f"S{i}" for i in range(12)], 756, seed=5, drift=0.004)
    scored = world.withColumn("score", X.zscore("quality"))
    noise = world.withColumn("score", synthetic.gaussian(F.col("symbol"), F.col("seq"), F.lit(1)))
    ic = lambda p: signal_quality.ic_summary(signal_quality.ic_series(p)).first()["t_stat"]
    assert ic(scored) > 3 > abs(ic(noise))
    again = synthetic.synthetic_world(spark, [f"S{i}" for i in range(12)], 756, seed=5, drift=0.004)
    assert again.agg(F.sum("close")).first() == world.agg(F.sum("close")).first()
    assert synthetic.synthetic_observations(world).where("available_date <= period_end").count() == 0
    docs = synthetic.transcripts(world)
    lean = docs.withColumn("tone", text_signals.keyword_tone("text")).where("abs(latent_sentiment) > 0.2 and signum(tone) <> signum(latent_sentiment)")
    assert docs.count() == 144 and lean.count() == 0
    with pytest.raises(ValueError):
        import numpy as np

        synthetic.innovations(np.random.default_rng(0), 5, True, 2)


def test_calendar(spark):
    days = spark.createDataFrame([(day(0),), (day(21),)], "date date")
    assert [r["seq"] for r in panel.calendar_of(days).orderBy("seq").collect()] == [1, 2, 3, 4]


def test_lint_and_ranges(spark, wide):
    from panelwright.plans import lint

    for name in ("momentum", "piotroski_f", "quality_score", "amihud_illiquidity"):
        assert lint.looks_ahead(factors.add_factors(wide, name, bars=factors.WEEKLY)) == []
    with pytest.raises(ValueError):
        lint.require_no_lookahead(wide.withColumn("x", X.forward_return("close", 1)))
    with pytest.raises(ValueError):
        lint.require_no_lookahead(wide.withColumn("x", F.avg("close").over(X.by_symbol().rowsBetween(-1, 1))))
    with pytest.raises(ValueError):
        lint.require_no_lookahead(wide.withColumn("x", F.lag("close", -1).over(X.by_symbol())))
    make = lambda p: factors.add_factors(p, "momentum", bars=factors.WEEKLY).select("symbol", "seq", "momentum")
    cut = lint.over_range(wide, make, 100, 120, 30)
    assert sorted(map(str, cut.collect())) == sorted(map(str, make(wide).where("seq between 100 and 120").collect()))
    assert "scores" in lint.register_views(spark, SF) and spark.sql("select count(*) from scores").first()[0] == 8925


def test_equity_heuristic(spark):
    assert [round(r["equity"], 6) for r in metrics.to_equity(series(spark, [0.1, -0.5])).orderBy("seq").collect()] == [1.1, 0.55]
    assert [r["equity"] for r in metrics.to_equity(series(spark, [2.0, 3.0])).orderBy("seq").collect()] == [2.0, 3.0]


@pytest.mark.parametrize("name, options", [
    ("lasso", {}), ("elastic_net", {}), ("random_forest", {"trees": 10, "leaf": 5}), ("xgboost", {"rounds": 10, "eta": 0.2}), ("lightgbm", {"rounds": 10, "rate": 0.2, "leaf": 5}),
    ("mlp", {"epochs": 200}), ("stacking", {"folds": 2, "rounds": 3}),
])
def test_every_model_learns_a_planted_line(spark, name, options):
    rows = spark.range(600).select(F.col("id").alias("row"), (F.pmod("id", F.lit(29)) / 14.5 - 1).alias("x1"), (F.pmod(F.col("id") * 7, F.lit(31)) / 15.5 - 1).alias("x2")).withColumn("y", F.lit(0.5) * F.col("x1") - F.lit(0.2) * F.col("x2")).coalesce(1).persist()
    fitted = models.make_model(name, **options)(rows.where("row < 450"), ["x1", "x2"])
    told = fitted.transform(rows.where("row >= 450"))
    assert told.count() == 150 and told.agg(F.corr("prediction", "y")).first()[0] > 0.8
    rows.unpersist()


def test_model_comparison(spark):
    world = synthetic.synthetic_world(spark, [f"S{i}" for i in range(8)], 160, seed=3, drift=0.01)
    bars = factors.Bars(momentum=10, skip=1, volatility=10, reversal=5)
    doc = workflow.run_model_comparison(world, ["momentum", "short_term_reversal"], horizon=5, n_folds=3, names=["lasso"], bars=bars)
    assert {r["model"] for r in doc["leaderboard"]} == {"elastic_net", "lasso"} and doc["n_folds"] == 3 and set(doc["coefficients"]) == {"momentum", "short_term_reversal"}
    assert all(r["n_dates"] > 100 and -1 <= r["rank_ic"] <= 1 for r in doc["leaderboard"])
    with pytest.raises(workflow.RequestError):
        workflow.run_model_comparison(world, [], 5)


def test_scores_of_many_look_backs_are_the_single_ones(spark):
    world = synthetic.price_panel(spark, [f"S{i}" for i in range(5)], 130, seed=4)
    for factor in workflow.PRICE_FACTORS:
        many = factors.add_scores(world, {f"s{k}": workflow.price_factor(factor, k, 2) for k in (8, 20)})
        for k in (8, 20):
            one = workflow.price_score(world, factor, k, 2).select("symbol", "seq", "score")
            assert many.join(one, ["symbol", "seq"]).where(~F.col(f"s{k}").eqNullSafe(F.col("score"))).isEmpty()


def test_rate_limit_by_hand(spark):
    rows = [(1, 1, 0), (1, 2, 5), (1, 3, 9), (1, 4, 10), (1, 5, 16), (None, 6, 3), (2, 7, None), (2, 8, 4)]
    hits = spark.createDataFrame(rows, "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    got = {r["event_id"]: r["admitted"] for r in streams.rate_limited(hits, 2, 10.0).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False, 8: True}
    assert streams.rate_limited(hits.where("false"), 2, 10.0).count() == 0


def test_response_documents_have_their_keys(spark):
    world = synthetic.synthetic_world(spark, [f"S{i}" for i in range(8)], 160, seed=5, drift=0.01)
    scored = factors.add_scores(world, {"score": workflow.price_factor("momentum", 20, 2)}).persist()
    card = signal_quality.compact_scorecard(scored)
    assert set(card) == {"mean_ic", "ic_tstat", "ic_ir", "ic_hit_rate", "ic_decay", "coverage", "rank_autocorr", "significant", "ic_sign_consistency", "ic_sign_stable", "ic_sign_verdict"}
    assert set(card["ic_decay"]) == {1, 5, 21} and 0 < card["coverage"] <= 1 and card["significant"] == (abs(card["ic_tstat"]) > 2)
    doc = workflow.overfitting(world, workflow.validate({"lookback": 20, "skip": 2, "periods": 160}), 160)
    assert {"pbo", "n_strategies", "n_combinations", "median_oos_sharpe_selected", "prob_oos_loss", "performance_degradation_slope", "histogram", "insufficient", "overfit", "verdict", "note"} <= set(doc)
    assert doc["n_combinations"] == 70 and sum(doc["histogram"]) == 70 and doc["overfit"] == (doc["pbo"] > 0.5) and doc["note"] == "ok"
    entries = workflow.catalogue()
    assert [e["name"] for e in entries if e["kind"] == "price"] == list(workflow.PRICE_FACTORS) and {e["name"] for e in entries} == {*workflow.PRICE_FACTORS, *workflow.FUNDAMENTAL_FACTORS}
    assert {e["name"] for e in entries if e["orientation"] < 0} == {"earnings_quality", "low_leverage", "conservative_investment", "low_issuance"}
    scored.unpersist()


def test_backtest_stats_by_configuration(spark):
    rows = [("a", s, r) for s, r in enumerate([0.1, -0.05, 0.02, -0.2], 1)] + [("b", s, 0.01) for s in range(1, 5)]
    curve = spark.createDataFrame(rows, "config string, seq int, net double").selectExpr("*", "exp(sum(ln(1 + net)) over (partition by config order by seq)) as equity", "1.0D as book", "0.5D as turnover")
    got = {r["config"]: r for r in metrics.backtest_stats(curve, ("config",)).collect()}
    assert got["a"]["episodes"] == 1 and got["a"]["longest"] == 3 and got["b"]["max_drawdown"] == 0 and got["a"]["holding_period"] == 4.0
    alone = metrics.backtest_stats(curve.where("config = 'a'")).collect()
    assert len(alone) == 1 and alone[0]["max_drawdown"] == got["a"]["max_drawdown"] and alone[0]["gain_hhi"] == got["a"]["gain_hhi"]


def test_verdict_is_about_models_that_are_not_linear():
    judge = models.judge
    assert judge({"elastic_net": 0.05, "lasso": 0.09, "mlp": 0.055})["verdict"] == "the linear model is not beaten"  # lasso is no complexity
    assert judge({"elastic_net": 0.0, "mlp": 0.01})["beats_linear"] and judge({"elastic_net": 0.0, "mlp": 0.01})["best_nonlinear"] == "mlp"  # the margin itself is enough
    assert judge({"elastic_net": None, "mlp": 0.5})["verdict"].startswith("inconclusive") and not judge({"elastic_net": None, "mlp": 0.5})["beats_linear"]
    assert not judge({"elastic_net": 0.05, "xgboost": None})["beats_linear"] and judge({"elastic_net": 0.05, "xgboost": None})["gain"] is None
    assert judge({"elastic_net": -0.02, "mlp": -0.005})["beats_linear"]


def test_attribution_in_one_call(spark):
    world = synthetic.synthetic_world(spark, [f"S{i}" for i in range(9)], 300, seed=6, drift=0.01)
    strategy = world.groupBy("date").agg((F.avg("ret") * 0.5 + F.lit(0.0003)).alias("net")) if "ret" in world.columns else attribution.factor_returns(world).select("date", (F.col("MKT") * 0.5 + 0.0003).alias("net"))
    fit = attribution.attribute(strategy, world, "ff5")
    assert fit["available_factors"][:2] == ["MKT", "UMD"] and not fit["fundamentals_used"] and fit["missing_factors"] == ["SMB", "HML", "RMW", "CMA"] and "prices only" in fit["note"]
    assert abs(fit["betas"]["MKT"] - 0.5) < 1e-6 and abs(fit["systematic_share"] - 1) < 1e-6
    nested = attribution.nested_models(strategy, attribution.factor_returns(world), ("MKT", "UMD"))
    assert [m["factors"] for m in nested] == [["MKT"], ["MKT", "UMD"]] and abs(nested[0]["betas"]["MKT"] - 0.5) < 1e-9 and nested[1]["r2"] >= nested[0]["r2"] - 1e-12
    data = np.random.default_rng(0).normal(size=(80, 4))
    frame = spark.createDataFrame([(datetime.date(2020, 1, 1) + datetime.timedelta(i), *map(float, r)) for i, r in enumerate(data)], "date date, net double, MKT double, SMB double, HML double")
    last = attribution.nested_models(frame.select("date", "net"), frame.drop("net"), ("MKT", "SMB", "HML"))[-1]
    whole = attribution.ols(frame, "net", ["MKT", "SMB", "HML"])
    assert np.allclose([last["alpha"], *last["betas"].values()], whole["coef"]) and np.allclose([last["alpha_t"], *last["beta_t"].values()], whole["t"]) and abs(last["r2"] - whole["r2"]) < 1e-9


def test_asof_joins(spark):
    at = lambda s: datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=s)
    left = spark.createDataFrame([(1, at(5), "a"), (1, at(200_000), "b"), (1, at(0), "c"), (2, at(9), "d"), (None, at(9), "e"), (1, None, "f"), (1, at(5), "g")], "k int, t timestamp, v string")
    right = spark.createDataFrame([(1, at(5), 1, 10), (1, at(5), 2, 20), (1, at(90_000), 3, 30), (3, at(1), 4, 40), (None, at(1), 5, 50), (1, None, 6, 60)], "k int, t timestamp, n int, v int")
    got = {r["v"]: r["right_v"] for r in asof.asof_join(left, right, ["k"], "t", values=["v"], order=["n"]).collect()}
    assert got == {"a": 20, "b": 30, "c": None, "d": None, "e": None, "f": None, "g": 20}
    near = {r["v"]: r["right_v"] for r in asof.asof_join(left, right, ["k"], "t", values=["v"], order=["n"], tolerance="1 day").collect()}
    assert near == got | {"b": None}
    for width in ("10 seconds", "30 days"):
        assert {r["v"]: r["right_v"] for r in asof.asof_join(left, right, ["k"], "t", values=["v"], order=["n"], width=width).collect()} == got
    assert asof.asof_join(left, right.where("false"), ["k"], "t").count() == 7 and asof.asof_join(left.where("false"), right, ["k"], "t").count() == 0
