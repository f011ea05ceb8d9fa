"""Registered queries of the factor library over the driver's tables, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.factors import EXTRA_METRICS, METRICS, SIGN, WEEKLY, add_factors, add_score
from ..operators import accounts, asof, attribution, guards, linear_folds, metrics, out_of_sample, portfolio, signal_quality, store, text_signals
from ..operators import point_in_time as pit
from ..session import Written
from ..sources import fixtures, observations, panel
from ..streaming import events as streams
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PPY = 52
r6 = X.r6


def register(name: str, oracle: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its doubles rounded for comparison."""
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


# Building blocks.


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.price_panel(spark, sf_dir)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_score(priced(spark, sf_dir), "momentum", WEEKLY)


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.add_weights(scored(spark, sf_dir))


def folio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.portfolio(portfolio.positions(weighted(spark, sf_dir)))


def fundamental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.place(fixtures.observations(spark, sf_dir), priced(spark, sf_dir), fixtures.weekly_calendar(spark, sf_dir), [*METRICS, *EXTRA_METRICS], 80)


def n_bars(spark: SparkSession, sf_dir: str) -> int:
    """Bars of the panel, counted on its calendar."""
    return fixtures.weekly_calendar(spark, sf_dir).count()


# Sources.


@register("brand_week_panel", S.query("px", f"select symbol, date, {S.r6('raw')} as raw, volume from px"))
def brand_week_panel(spark, sf_dir):
    return fixtures.brand_weeks(spark, sf_dir).withColumn("raw", r6("raw"))


@register("dense_panel_ffill", S.query("filled", f"select symbol, sym_pos, date, seq, {S.r6('raw')} as raw, volume from filled"))
def dense_panel_ffill(spark, sf_dir):
    return fixtures.dense_prices(spark, sf_dir).select("symbol", "sym_pos", "date", "seq", r6("raw").alias("raw"), "volume")


@register("price_panel", S.query("panel", f"select symbol, sym_pos, date, seq, {S.r6('close')} as close, {S.r6('ret')} as ret, volume from panel"))
def price_panel(spark, sf_dir):
    return priced(spark, sf_dir).select("symbol", "sym_pos", "date", "seq", r6("close").alias("close"), r6("ret").alias("ret"), "volume")


_OBS = " union all ".join(f"select symbol, period_end, cast(period_end + 75 as date) as available_date, '{m}' as metric, {S.r6(m)} as value from quarters where {m} is not null" for m in (*METRICS, *EXTRA_METRICS))


@register("obs_unpivot", S.query("quarters", _OBS))
def obs_unpivot(spark, sf_dir):
    return fixtures.observations(spark, sf_dir).where("value is not null").withColumn("value", r6("value"))


_VENDOR_MAP = {"revenue": "Revenue", "net_income": "Net Income", "rnd": "Absent"}


@register("vendor_unpivot", S.query("quarters", f"""select symbol, period_end, cast(period_end + 75 as date) as available_date, 'revenue' as metric, {S.r6('revenue')} as value from quarters where revenue > 10000
  union all select symbol, period_end, cast(period_end + 75 as date), 'net_income', {S.r6('net_income')} from quarters"""))
def vendor_unpivot(spark, sf_dir):
    wide = fixtures.quarters(spark, sf_dir).select(
        F.col("symbol").alias("Ticker"), F.col("period_end").cast("string").alias("Report Date"), F.date_add("period_end", 75).cast("string").alias("Publish Date"),
        F.when(F.col("revenue") > 10000, F.col("revenue").cast("string")).otherwise("n/a").alias("Revenue"), F.col("net_income").alias("Net Income"), F.lit("x").alias("Irrelevant"),
    )
    return observations.unpivot_vendor(wide, _VENDOR_MAP, "Ticker", "Report Date", "Publish Date").withColumn("value", r6("value"))


@register("union_vendor_parts", S.query("quarters", " union all ".join(f"select symbol, period_end, cast(period_end + 75 as date) as available_date, '{m}' as metric, {S.r6(m)} as value from quarters where symbol in ('Brand#11', 'Brand#12') and period_end + 75 >= date '1996-01-01'" for m in ("revenue", "total_assets", "capex"))))
def union_vendor_parts(spark, sf_dir):
    q = fixtures.quarters(spark, sf_dir).select(F.col("symbol").alias("Ticker"), F.col("period_end").alias("Report Date"), F.date_add("period_end", 75).alias("Publish Date"), "revenue", "total_assets", "capex")
    part = lambda m, v: q.select("Ticker", "Report Date", "Publish Date", F.col(m).alias(v))
    obs = observations.simfin(part("revenue", "Revenue"), part("total_assets", "Total Assets"), part("capex", "Change in Fixed Assets & Intangibles"), ["brand#11", "brand#12"], start="1996-01-01")
    return obs.withColumn("symbol", F.initcap("symbol")).withColumn("value", r6("value"))


@register("orders_latest_upsert", "select o_custkey, o_orderkey, o_orderstatus, cast(o_orderdate as date) as o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def orders_latest_upsert(spark, sf_dir):
    orders = fixtures.read(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_custkey", "o_orderstatus")
    return store.latest(orders, ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o_orderdate"))


# Point in time.


@register("pit_panel", S.query("pit", f"select symbol, date, seq, {S.r6('net_income')} as net_income from pit"))
def pit_panel(spark, sf_dir):
    placed = pit.place(fixtures.observations(spark, sf_dir), priced(spark, sf_dir), fixtures.weekly_calendar(spark, sf_dir), ["net_income"], 80)
    return placed.select("symbol", "date", "seq", r6("net_income").alias("net_income"))


@register("pit_staleness", S.query("pit", f"""select symbol, date, seq, {S.r6('x')} as revenue from (select symbol, date, seq, last_value(x0 ignore nulls) over (partition by symbol order by seq rows between 5 preceding and current row) as x
  from (select p.*, f.revenue as x0 from panel p left join (select * from placed qualify row_number() over (partition by symbol, bar order by period_end desc) = 1) f on f.symbol = p.symbol and f.bar = p.seq))"""))
def pit_staleness(spark, sf_dir):
    placed = pit.place(fixtures.observations(spark, sf_dir), priced(spark, sf_dir), fixtures.weekly_calendar(spark, sf_dir), ["revenue"], 5)
    return placed.select("symbol", "date", "seq", r6("revenue").alias("revenue"))


_WIDE = ("revenue", "total_assets", "common_equity", "capex")


@register("pit_bundle_wide", S.query("pit", f"select symbol, date, seq, {', '.join(f'{S.r6(m)} as {m}' for m in _WIDE)} from pit"))
def pit_bundle_wide(spark, sf_dir):
    return fundamental(spark, sf_dir).select("symbol", "date", "seq", *[r6(m).alias(m) for m in _WIDE])


@register("label_end_dates", S.query("panel", f"select symbol, date, seq, lead(date, 4) over (partition by symbol order by seq) as label_end, {S.r6(S.safe('lead(close, 4) over (partition by symbol order by seq)', 'close') + ' - 1')} as label from panel"))
def label_end_dates(spark, sf_dir):
    return pit.label_end(priced(spark, sf_dir), 4).select("symbol", "date", "seq", "label_end", r6(X.forward_return("close", 4)).alias("label"))


_POS, _NEG = ("th", "er"), ("an", "in")
_N = lambda ws: " + ".join(f"len(regexp_extract_all(lower(coalesce(text, '')), '{w}'))" for w in ws)
S.define("toned", "", f"select doc_id, case when p + n > 0 then (p - n) / cast(p + n as double) else 0.0 end as tone from (select doc_id, {_N(_POS)} as p, {_N(_NEG)} as n from documents)")
S.define("docs", "toned sym cal", "select t.doc_id, s.symbol, c.date, c.seq, t.tone from toned t join sym s on s.sym_pos = 1 + t.doc_id % 25 join cal c on c.seq = 1 + (t.doc_id * 37) % 357")


@register("keyword_score", S.query("toned", f"select doc_id, {S.r6('tone')} as tone from toned"))
def keyword_score(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "documents").select("doc_id", r6(text_signals.keyword_tone("text", list(_POS), list(_NEG))).alias("tone"))


@register("text_signal_panel", S.query("docs panel", f"""select symbol, date, seq, {S.r6('coalesce(t, 0.0)')} as tone from (select p.symbol, p.date, p.seq, last_value(d.tone ignore nulls) over (partition by p.symbol order by p.seq rows between 10 preceding and current row) as t
  from panel p left join (select * from docs qualify row_number() over (partition by symbol, seq order by doc_id desc) = 1) d on d.symbol = p.symbol and d.seq = p.seq)"""))
def text_signal_panel(spark, sf_dir):
    prices, calendar = priced(spark, sf_dir), fixtures.weekly_calendar(spark, sf_dir)
    symbols = prices.select("symbol", "sym_pos").distinct()
    toned = fixtures.read(spark, sf_dir, "documents").select("doc_id", text_signals.keyword_tone("text", list(_POS), list(_NEG)).alias("tone"))
    docs = toned.join(symbols, F.col("sym_pos") == 1 + F.col("doc_id") % 25).join(calendar, F.col("seq") == 1 + (F.col("doc_id") * 37) % 357).select("doc_id", "symbol", "date", "tone")
    return pit.place_scores(docs, prices, calendar, "tone", 10).select("symbol", "date", "seq", r6("tone").alias("tone"))


# Price factors and cross-sections.

_PRICE = ("momentum", "momentum_12_1", "trailing_volatility", "short_term_reversal")


def _price_query(name: str):
    @register(name, S.query("priced", f"select symbol, date, seq, {S.r6(name)} as {name} from priced"))
    def run(spark, sf_dir):
        return add_factors(priced(spark, sf_dir), name, bars=WEEKLY).select("symbol", "date", "seq", r6(name).alias(name))


for _name in _PRICE:
    _price_query(_name)

_AMIHUD = "avg(impact) over (partition by symbol order by seq rows between 3 preceding and current row)"


@register("amihud", S.query("priced", f"select symbol, date, seq, {S.r6(f'1e6 * case when count(impact) over (partition by symbol order by seq rows between 3 preceding and current row) >= 2 then {_AMIHUD} end')} as amihud from priced"))
def amihud(spark, sf_dir):
    return add_factors(priced(spark, sf_dir), "amihud_illiquidity", bars=WEEKLY).select("symbol", "date", "seq", r6(F.lit(1e6) * F.col("amihud_illiquidity")).alias("amihud"))


_BLEND = f"(coalesce({S.z('momentum')}, 0.0) + coalesce({S.z('(-trailing_volatility)')}, 0.0) + coalesce({S.z('short_term_reversal')}, 0.0)) / 3"


@register("blend_price", S.query("priced", f"select symbol, date, seq, {S.r6(_BLEND)} as blend_price from priced"))
def blend_price(spark, sf_dir):
    return add_factors(priced(spark, sf_dir), "blend_price", bars=WEEKLY).select("symbol", "date", "seq", r6("blend_price").alias("blend_price"))


@register("zscore", S.query("score", f"select symbol, date, seq, {S.r6('score')} as score from score"))
def zscore(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol", "date", "seq", r6("score").alias("score"))


@register("ls_weights", S.query("weights", f"select symbol, date, seq, {S.r6('weight')} as weight from weights"))
def ls_weights(spark, sf_dir):
    return weighted(spark, sf_dir).select("symbol", "date", "seq", r6("weight").alias("weight"))


@register("avg_rank", S.query("paired", f"select symbol, date, seq, {S.avg_rank('round(score, 1)', 'date')} as rank from paired"))
def avg_rank(spark, sf_dir):
    known = signal_quality.with_forward(scored(spark, sf_dir)).where("score is not null and fwd is not null").withColumn("coarse", F.round("score", 1))
    return known.select("symbol", "date", "seq", X.average_rank("coarse", "date").alias("rank"))


_BUCKET = "cast(greatest(0, ceil((r - 1) * 5 / cast(m - 1 as double)) - 1) as integer)"
S.define("bucketed", "paired", f"select *, {_BUCKET} as bucket from (select *, row_number() over (partition by date order by score, sym_pos) as r, count(*) over (partition by date) as m from paired) where m >= 10")


@register("qcut_buckets", S.query("bucketed", "select symbol, date, seq, bucket from bucketed"))
def qcut_buckets(spark, sf_dir):
    known = signal_quality.with_forward(scored(spark, sf_dir)).where("score is not null and fwd is not null")
    part = Window.partitionBy("date")
    ranked = known.withColumns({"r": F.row_number().over(part.orderBy("score", "sym_pos")), "m": F.count(F.lit(1)).over(part)}).where("m >= 10")
    return ranked.select("symbol", "date", "seq", X.quantile_bucket(F.col("r"), F.col("m"), 5).alias("bucket"))


S.define("terciles", "score", f"""select date, seq, avg(case when r > m - m // 3 then ret end) - avg(case when r <= m // 3 then ret end) as spread from
  (select date, seq, ret, row_number() over (partition by date order by s, sym_pos) as r, count(*) over (partition by date) as m from (select *, {S.lag('score', 1)} as s from score) where s is not null and ret is not null) where m >= 3 group by 1, 2""")


@register("tercile_spread", S.query("terciles", f"select date, seq, {S.r6('spread')} as spread from terciles"))
def tercile_spread(spark, sf_dir):
    return attribution.tercile_long_short(scored(spark, sf_dir), {"momentum": "score"}).select("date", "seq", r6("ret").alias("spread"))


# Fundamental factors.


def _screen_query(name: str):
    @register(name, S.query("screens", f"select symbol, date, seq, {S.r6(name)} as {name} from screens"))
    def run(spark, sf_dir):
        return add_factors(fundamental(spark, sf_dir), name, bars=WEEKLY).select("symbol", "date", "seq", r6(name).alias(name))


for _name in (*S.LEVEL, *S.LAGGED):
    _screen_query(_name)

_Z = S.z
_COMPOSITES = {
    "quality_score": "(" + " + ".join(f"coalesce({_Z(x)}, 0.0)" for x in ("gross_profitability", "roe", "operating_margin", "(-sloan_accruals)", "(-leverage)")) + ") / 5",
    "value_score": "(" + " + ".join(f"coalesce({_Z(x)}, 0.0)" for x in ("earnings_yield", "book_to_price", "sales_to_price", "fcf_yield")) + ") / 4",
    "value_with_fraud_guardrail": "case when coalesce(a, b, c, d) is not null then coalesce(a, 0.0) + coalesce(b, 0.0) - coalesce(c, 0.0) - coalesce(d, 0.0) end",
    "profitable_value": f"{_Z('book_to_price')} * {_Z('gross_profitability')}",
    "conservative_compounder": "case when coalesce(e, f, g) is not null then coalesce(e, 0.0) - coalesce(f, 0.0) - coalesce(g, 0.0) end",
}
S.define("zs", "screens", f"select *, {_Z('book_to_price')} as a, {_Z('ebit_to_ev')} as b, {_Z('beneish_m')} as c, {_Z('ohlson_o')} as d, {_Z('gross_profitability')} as e, {_Z('asset_growth')} as f, {_Z('trailing_volatility')} as g from screens")


def _composite_query(name: str, body: str):
    @register(name, S.query("zs", f"select symbol, date, seq, {S.r6(body)} as {name} from zs"))
    def run(spark, sf_dir):
        return add_factors(fundamental(spark, sf_dir), name, bars=WEEKLY).select("symbol", "date", "seq", r6(name).alias(name))


for _name, _body in _COMPOSITES.items():
    _composite_query(_name, _body)

# Ratio metrics: per-share and ratio observations made from the bundle.
_RATIO_SQL = {
    "ratio_value_score": "(" + " + ".join(f"coalesce({_Z(x)}, 0.0)" for x in ("(0.001 * eps / close)", "(0.001 * bv / close)", "(0.001 * sp / close)")) + ") / 3",
    "ratio_quality_score": "(" + " + ".join(f"coalesce({_Z(x)}, 0.0)" for x in ("roe", "gross_profitability", "(-leverage)")) + ") / 3",
}
S.define("ratios", "pit", f"select symbol, date, seq, close, {S.safe('net_income', 'shares_diluted')} as eps, {S.safe('common_equity', 'shares_diluted')} as bv, {S.safe('revenue', 'shares_diluted')} as sp, {S.LEVEL['roe']} as roe, {S.LEVEL['gross_profitability']} as gross_profitability, {S.LEVEL['leverage']} as leverage from pit")


@register("value_quality", S.query("ratios", f"select symbol, date, seq, {S.r6('(' + _RATIO_SQL['ratio_value_score'] + ' + ' + _RATIO_SQL['ratio_quality_score'] + ') / 2')} as value_quality from ratios"))
def value_quality(spark, sf_dir):
    base = add_factors(fundamental(spark, sf_dir), "roe", "gross_profitability", "leverage", bars=WEEKLY)
    per_share = lambda m: F.lit(0.001) * X.safe_div(m, "shares_diluted")
    ratio = base.withColumns({"eps_ttm": per_share("net_income"), "bvps": per_share("common_equity"), "sps": per_share("revenue")})
    return add_factors(ratio, "value_quality_score", bars=WEEKLY).select("symbol", "date", "seq", r6("value_quality_score").alias("value_quality"))


# Backtests.


@register("backtest_returns", S.query("folio", f"select date, seq, {S.r6('gross')} as gross, {S.r6('turnover')} as turnover, {S.r6('net')} as net from folio"))
def backtest_returns(spark, sf_dir):
    return folio(spark, sf_dir).select("date", "seq", *[r6(c).alias(c) for c in ("gross", "turnover", "net")])


@register("backtest_equity", S.query("curve", f"select date, seq, {S.r6('net')} as net, {S.r6('equity')} as equity from curve"))
def backtest_equity(spark, sf_dir):
    return portfolio.backtest(weighted(spark, sf_dir)).select("date", "seq", r6("net").alias("net"), r6("equity").alias("equity"))


@register("turnover_costs", S.query("folio", f"select {S.r6('avg(turnover)')} as avg_turnover, {S.r6('100 * sum(turnover * 0.0005)')} as cost_pct, {S.r6('avg(book)')} as avg_book from folio"))
def turnover_costs(spark, sf_dir):
    return folio(spark, sf_dir).agg(r6(F.avg("turnover")).alias("avg_turnover"), r6(100 * F.sum(F.col("gross") - F.col("net"))).alias("cost_pct"), r6(F.avg("book")).alias("avg_book"))


@register("cost_sweep", S.query("folio", f"select bps, {S.r6('product(1 + gross - turnover * bps / 10000.0::double)')} as final_equity from folio cross join (values (0), (5), (10), (50), (100)) b(bps) group by bps"))
def cost_sweep(spark, sf_dir):
    swept = folio(spark, sf_dir).withColumn("bps", F.explode(F.array(*map(F.lit, (0, 5, 10, 50, 100)))))
    return swept.groupBy("bps").agg(r6(F.product(1 + F.col("gross") - F.col("turnover") * F.col("bps") / 10000.0)).alias("final_equity"))


@register("drawdown_curve", S.query("peaked", f"select date, seq, {S.r6('equity / peak - 1')} as drawdown from peaked"))
def drawdown_curve(spark, sf_dir):
    return portfolio.backtest(weighted(spark, sf_dir)).select("date", "seq", r6("drawdown").alias("drawdown"))


@register("drawdown_islands", S.query("peaked", f"""select {S.r6('min(dd)')} as max_drawdown, cast(max(run) as bigint) as longest, count(case when run > 0 then 1 end) as episodes from
  (select island, sum(under) as run, min(equity / peak - 1) as dd from (select *, sum(1 - under) over (order by seq rows between unbounded preceding and current row) as island from (select *, case when equity < peak then 1 else 0 end as under from peaked)) group by island)"""))
def drawdown_islands(spark, sf_dir):
    return rounded(metrics.drawdown_stats(portfolio.backtest(weighted(spark, sf_dir))))


@register("downsample_curve", S.query("curve", """select date, seq, round(equity, 6) + 0.0 as equity from (select *, row_number() over (order by seq) - 1 as i, count(*) over () as n,
  row_number() over (order by equity, seq) as lo, row_number() over (order by equity desc, seq) as hi from curve) where i % greatest(1, n // 50) = 0 or i = n - 1 or lo = 1 or hi = 1"""))
def downsample_curve(spark, sf_dir):
    curve = portfolio.backtest(weighted(spark, sf_dir)).select("date", "seq", "equity")
    return portfolio.downsample(curve, points=50).withColumn("equity", r6("equity"))


# Metrics of the net returns.

_SH = "case when count(net) >= 2 and stddev_samp(net) >= 1e-12 then avg(net) / stddev_samp(net) else 0.0 end"
_G1 = "case when count(net) > 2 and stddev_pop(net) > 0 then skewness(net) end"
_K = "kurtosis_pop(net)"


@register("summary_moments", S.query("folio", f"""select count(net) as n, {S.r6(_SH)} as sharpe_pp, {S.r6(f'({_SH}) * sqrt(52.0::double)')} as sharpe, {S.r6('case when product(1 + net) <= 0 then -1.0 else pow(product(1 + net), 52.0::double / count(net)) - 1 end')} as cagr,
  {S.r6('stddev_samp(net) * sqrt(52.0::double)')} as volatility, {S.r6(_G1)} as skew, {S.r6('kurtosis(net)')} as kurtosis from folio"""))
def summary_moments(spark, sf_dir):
    return rounded(metrics.moments(folio(spark, sf_dir), ppy=PPY).select("n", "sharpe_pp", "sharpe", "cagr", "volatility", "skew", "kurtosis"))


@register("sortino_calmar", S.query("peaked", f"""select {S.r6('case when stddev_samp(case when net < 0 then net end) > 0 then avg(net) / stddev_samp(case when net < 0 then net end) * sqrt(52.0::double) end')} as sortino,
  {S.r6('(case when product(1 + net) <= 0 then -1.0 else pow(product(1 + net), 52.0::double / count(net)) - 1 end) / abs(nullif(min(equity / peak - 1), 0))')} as calmar from peaked"""))
def sortino_calmar(spark, sf_dir):
    net = F.col("net")
    calmar = metrics.annual_return(net, PPY) / F.abs(F.nullif(F.min("drawdown"), F.lit(0.0)))
    return portfolio.backtest(weighted(spark, sf_dir)).agg(r6(metrics.sortino(net, PPY)).alias("sortino"), r6(calmar).alias("calmar"))


@register("hit_rate", S.query("folio", f"select {S.r6('avg(case when net <> 0 then cast(net > 0 as integer) end)')} as hit_rate from folio"))
def hit_rate(spark, sf_dir):
    return folio(spark, sf_dir).agg(r6(metrics.hit_rate(F.col("net"))).alias("hit_rate"))


@register("jarque_bera", S.query("folio", f"""select count(net) as n, {S.r6(f"case when count(net) >= 8 then exp(-(count(net) / 6.0::double) * (pow(m3 / pow(m2, 1.5), 2) + pow(any_value(k), 2) / 4) / 2) end")} as jarque_bera_p
  from (select net, (select avg(pow(net - (select avg(net) from folio), 3)) from folio) as m3, (select avg(pow(net - (select avg(net) from folio), 2)) from folio) as m2, (select {_K} from folio) as k from folio) group by m2, m3"""))
def jarque_bera(spark, sf_dir):
    return folio(spark, sf_dir).agg(F.count("net").alias("n"), r6(metrics.jarque_bera_p(F.col("net"))).alias("jarque_bera_p"))


def _hhi(x: str) -> str:
    return f"case when count({x}) >= 2 then (sum(({x}) * ({x})) / (sum({x}) * sum({x})) - 1.0::double / count({x})) / (1 - 1.0::double / count({x})) end"


@register("hhi", S.query("folio", f"select {S.r6(_hhi('case when net > 0 then net end'))} as gain_hhi, {S.r6(_hhi('case when net < 0 then -net end'))} as loss_hhi from folio"))
def hhi(spark, sf_dir):
    return rounded(metrics.moments(folio(spark, sf_dir), ppy=PPY).select("gain_hhi", "loss_hhi"))


@register("var_cvar", S.query("folio", f"""select n, {S.r6('-cut')} as var, {S.r6('-tail')} as cvar from (select count(*) as n, max(c) as cut, avg(case when net <= c then net end) as tail from
  (select net, max(case when k = floor((n - 1) * (1 - 0.95::double)) + 1 then net end) over () as c from (select net, row_number() over (order by net) as k, count(*) over () as n from folio)))"""))
def var_cvar(spark, sf_dir):
    return rounded(metrics.tail_risk(folio(spark, sf_dir)))


@register("holding_period", S.query("folio", f"select {S.r6('avg(book) / (avg(turnover) / 2)')} as holding_period from folio"))
def holding_period(spark, sf_dir):
    return rounded(metrics.holding_period(folio(spark, sf_dir)))


def _one_row(spark: SparkSession, values: dict, kinds: str) -> DataFrame:
    names = [k.split()[0] for k in kinds.split(",")]
    return spark.createDataFrame([tuple(values[n] for n in names)], kinds)


# The normal distribution by its power series; quantiles of the expected best of 50 are constants.
_PHI = lambda z: f"0.5 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * ({z}) * list_sum(list_transform(range(0, 200), lambda i: exp(i * ln(greatest(({z}) * ({z}) / 2, 1e-300)) - lgamma(i + 1.5) + lgamma(1.5))))"
_BEST = sum(w * NormalDist().inv_cdf(1 - 1 / (50 * e)) for w, e in ((1 - metrics.EULER_GAMMA, 1), (metrics.EULER_GAMMA, math.e)))


@register("psr_dsr", S.query("folio", f"""select {S.r6(_PHI('s * w'))} as psr, {S.r6(_PHI(f'(s - sqrt((1 + s * s / 2) / (n - 1)) * {_BEST}) * w'))} as dsr from (select s, n, sqrt(n - 1.0::double) / sqrt(1 - g * s + (k + 2) / 4 * s * s) as w from
  (select cast(count(net) as double) as n, {_SH} as s, {_G1} as g, kurtosis(net) as k from folio))"""))
def psr_dsr(spark, sf_dir):
    m = metrics.moments(folio(spark, sf_dir), ppy=PPY).first()
    return rounded(_one_row(spark, {
        "psr": metrics.probabilistic_sharpe(m["sharpe_pp"], m["n"], m["skew"], m["kurtosis"]),
        "dsr": metrics.deflated_sharpe(m["sharpe_pp"], m["n"], m["skew"], m["kurtosis"], 50),
    }, "psr double, dsr double"))


# Signal quality.


@register("ic_series", S.query("ic", f"select date, seq, {S.r6('ic')} as ic, n from ic"))
def ic_series(spark, sf_dir):
    return rounded(signal_quality.ic_series(scored(spark, sf_dir)))


@register("ic_summary", S.query("ic", f"select count(ic) as n, {S.r6('avg(ic)')} as mean_ic, {S.r6('stddev_samp(ic)')} as std_ic, {S.r6('avg(ic) / stddev_samp(ic)')} as ir, {S.r6('avg(ic) / stddev_samp(ic) * sqrt(cast(count(ic) as double))')} as t_stat, {S.r6('avg(cast(round(ic, 12) > 0 as integer))')} as hit_rate from ic"))
def ic_summary(spark, sf_dir):
    return rounded(signal_quality.ic_summary(signal_quality.ic_series(scored(spark, sf_dir))))


_DECAY = " union all ".join(f"select {h} as horizon, date, score as s, {S.safe(f'lead(close, {h}) over (partition by symbol order by seq)', 'close')} - 1 as f from score" for h in (1, 5, 10, 21))
S.define("decays", "score", _DECAY)


@register("ic_decay", S.query("decays", f"""select horizon, {S.r6('case when count(c) >= 3 then avg(c) end')} as mean_ic, count(c) as n from (select horizon, date, {S.corr('a', 'b')} as c, count(*) as k from
  (select horizon, date, {S.avg_rank('s', 'horizon, date')} as a, {S.avg_rank('f', 'horizon, date')} as b from decays where s is not null and f is not null) group by 1, 2) where k >= 5 and c is not null group by 1"""))
def ic_decay(spark, sf_dir):
    return rounded(signal_quality.ic_decay(scored(spark, sf_dir), horizons=(1, 5, 10, 21)))


S.define("by_bucket", "bucketed", "select bucket, avg(m) as mean_fwd, count(m) as n_dates from (select date, bucket, avg(fwd) as m from bucketed group by 1, 2) group by 1")


@register("quantile_returns", S.query("by_bucket", f"select bucket, {S.r6('mean_fwd')} as mean_fwd, n_dates from by_bucket"))
def quantile_returns(spark, sf_dir):
    return rounded(signal_quality.quantile_returns(scored(spark, sf_dir)))


@register("quantile_spread", S.query("by_bucket", f"select {S.r6('max_by(mean_fwd, bucket) - min_by(mean_fwd, bucket)')} as top_minus_bottom, coalesce(min(step) >= 0, false) as monotone from (select *, mean_fwd - lag(mean_fwd) over (order by bucket) as step from by_bucket)"))
def quantile_spread(spark, sf_dir):
    return rounded(signal_quality.quantile_spread(signal_quality.quantile_returns(scored(spark, sf_dir))))


@register("rank_autocorr", S.query("score", f"""select {S.r6('avg(c)')} as autocorrelation, count(c) as n_dates from (select date, {S.corr('k', 'b')} as c, count(*) as n from
  (select s.symbol, s.seq, s.date, r.k, lag(r.k, 1) over (partition by s.symbol order by s.seq) as b from score s left join (select symbol, seq, {S.avg_rank('score', 'date')} as k from score where score is not null) r on r.symbol = s.symbol and r.seq = s.seq)
  where k is not null and b is not null group by 1) where n >= 5 and c is not null"""))
def rank_autocorr(spark, sf_dir):
    return rounded(signal_quality.rank_autocorrelation(scored(spark, sf_dir)))


@register("coverage", S.query("score", f"select {S.r6('avg(c)')} as coverage from (select date, avg(cast(score is not null as integer)) as c from score group by 1)"))
def coverage(spark, sf_dir):
    return rounded(signal_quality.coverage(scored(spark, sf_dir)))


@register("sign_stability", S.query("ic", f"""select n, {S.r6('avg(cast(sign(m) = s as integer))')} as consistency, cast(s as integer) as dominant_sign, avg(cast(sign(m) = s as integer)) >= 0.8 as stable from
  (select era, avg(ic) as m, any_value(n) as n, any_value(s) as s from (select ic, ntile(6) over (order by seq) as era, (select count(*) from ic) as n, (select sign(avg(ic)) from ic) as s from ic) group by era) group by n, s"""))
def sign_stability(spark, sf_dir):
    return rounded(signal_quality.sign_stability(signal_quality.ic_series(scored(spark, sf_dir))))


@register("extraction_stability", f"select {S.r6('avg(s)')} as mean_std, {S.r6('max(s)')} as max_std, max(s) < 1e-9 as deterministic from (select user_id, stddev_pop(value) as s from events group by 1)")
def extraction_stability(spark, sf_dir):
    return rounded(signal_quality.extraction_stability(fixtures.read(spark, sf_dir, "events"), "user_id", "value"))


# Out of sample.

S.define("folds", "folio", "select 1 as one")
_BARS = "(select max(seq) from weights)"


def _folded(fold: str, zero: str) -> str:
    """Fold-wise backtest of the momentum weights."""
    w = "partition by fold, symbol order by seq"
    return f"""select fold, date, seq, sum(pos * r) - sum(turn) * 0.0005 as net from (select fold, date, seq, coalesce(lag(wt, 1) over ({w}), 0.0) as pos, coalesce({S.safe('close', f'lag(close, 1) over ({w})')} - 1, 0.0) as r,
      case when row_number() over ({w}) = 1 then 0.0 else abs(coalesce(lag(wt, 1) over ({w}), 0.0) - coalesce(lag(wt, 2) over ({w}), 0.0)) end as turn
      from (select *, case when {zero} then 0.0 else weight end as wt from (select *, {fold} as fold from weights))) group by 1, 2, 3"""


S.define("split2", "weights", _folded(f"cast(seq > floor({_BARS} * 0.7) as integer)", "false"))


@register("split_backtest", S.query("split2", f"select fold, count(net) as n, {S.r6(f'({_SH}) * sqrt(52.0::double)')} as sharpe from split2 group by 1"))
def split_backtest(spark, sf_dir):
    w = weighted(spark, sf_dir)
    returns = out_of_sample.fold_returns(out_of_sample.with_split(w, n_bars(spark, sf_dir)))
    return rounded(metrics.moments(returns, ppy=PPY, keys=("fold",)).select("fold", "n", "sharpe"))


_FOLD5 = "case " + " ".join(f"when seq > {_BARS} * {k} // 5 then {k}" for k in (4, 3, 2, 1)) + " else 0 end"
S.define("walk5", "weights", _folded(_FOLD5, f"seq - 1 - {_BARS} * fold // 5 < 31"))


@register("walk_forward", S.query("walk5", f"select fold, count(net) as n, {S.r6(f'({_SH}) * sqrt(52.0::double)')} as sharpe from (select *, min(seq) over (partition by fold) as lo from walk5) where fold > 0 and seq >= lo + 31 group by 1"))
def walk_forward(spark, sf_dir):
    w = weighted(spark, sf_dir)
    returns = out_of_sample.fold_returns(out_of_sample.with_folds(w, n_bars(spark, sf_dir), 5, 31), lead=31).where("fold > 0")
    return rounded(metrics.moments(returns, ppy=PPY, keys=("fold",)).select("fold", "n", "sharpe"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, symbol, sym_pos, date, label_start, label_end, y, x1, x2, x3): z-scored price factors and the 4-week label."""
    names = ("momentum", "trailing_volatility", "short_term_reversal")
    with_raw = add_factors(priced(spark, sf_dir), *names, bars=WEEKLY)
    z = with_raw.select("symbol", "sym_pos", "date", "seq", *[X.zscore(F.col(n) * SIGN.get(n, 1)).alias(f"x{i}") for i, n in enumerate(names, 1)], X.forward_return("close", 4).alias("y"), F.lead("seq", 4).over(X.by_symbol()).alias("label_end"))
    kept = z.where("y is not null and label_end is not null and coalesce(x1, x2, x3) is not null").fillna(0.0, ["x1", "x2", "x3"]).withColumnRenamed("seq", "label_start")
    return out_of_sample.with_row(kept)


S.define("feats", "priced", f"""select *, row_number() over (order by date, sym_pos) - 1 as row from (select symbol, sym_pos, date, seq as label_start, lead(seq, 4) over (partition by symbol order by seq) as label_end, {S.safe('lead(close, 4) over (partition by symbol order by seq)', 'close')} - 1 as y,
  {S.z('momentum')} as x1, {S.z('(-trailing_volatility)')} as x2, {S.z('short_term_reversal')} as x3 from priced) where y is not null and label_end is not null and coalesce(x1, x2, x3) is not null""")


@register("feature_panel", S.query("feats", f"select row, symbol, date, label_start, label_end, {S.r6('y')} as y, {S.r6('coalesce(x1, 0.0)')} as x1, {S.r6('coalesce(x2, 0.0)')} as x2, {S.r6('coalesce(x3, 0.0)')} as x3 from feats"))
def feature_panel(spark, sf_dir):
    return rounded(features(spark, sf_dir).select("row", "symbol", "date", "label_start", "label_end", "y", "x1", "x2", "x3"))


_SPANS = "select fold, min(label_start) as s, max(label_end) as e, min(row) as lo, max(row) as hi from (select *, {f} as fold from feats) group by 1"
_F5 = "case " + " ".join(f"when row < (select count(*) from feats) * {k + 1} // 5 then {k}" for k in range(4)) + " else 4 end"
S.define("spans5", "feats", _SPANS.format(f=_F5))


@register("purged_kfold_sizes", S.query("spans5", """select fold, role, count(*) as n, cast(min(row) as bigint) as lo, cast(max(row) as bigint) as hi from (select p.fold, f.row, case when f.row between p.lo and p.hi then 'test'
  when (f.label_end < p.s or f.label_start > p.e) and not (f.row > p.hi and f.row <= p.hi + ceil((select count(*) from feats) * 0.02::double)) then 'train' end as role from feats f cross join spans5 p) where role is not null group by 1, 2"""))
def purged_kfold_sizes(spark, sf_dir):
    rows = features(spark, sf_dir).select("row", "n_rows", "label_start", "label_end")
    folds = out_of_sample.purged_folds(rows, None, 5, 0.02)
    return folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("row").cast("long").alias("lo"), F.max("row").cast("long").alias("hi"))


_F4 = "case " + " ".join(f"when row < (select count(*) from feats) * {k + 1} // 4 then {k}" for k in range(3)) + " else 3 end"
S.define("spans4", "feats", _SPANS.format(f=_F4))
_PATHS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate((a, b) for a in range(4) for b in range(a + 1, 4)))
_BLOCKED = "((f.label_start <= {p}.e and {p}.s <= f.label_end) or (f.row > {p}.hi and f.row <= {p}.hi + ceil((select count(*) from feats) * 0.01::double)))"


@register("cpcv_paths", S.query("spans4", f"""select path, role, count(*) as n from (select path, case when f.row between a.lo and a.hi or f.row between b.lo and b.hi then 'test' when not {_BLOCKED.format(p='a')} and not {_BLOCKED.format(p='b')} then 'train' end as role
  from feats f cross join (values {_PATHS}) paths(path, g, h) join spans4 a on a.fold = g join spans4 b on b.fold = h) where role is not null group by 1, 2"""))
def cpcv_paths(spark, sf_dir):
    rows = features(spark, sf_dir).select("row", "n_rows", "label_start", "label_end")
    return out_of_sample.combinatorial_paths(rows, None, 4, 2, 0.01).groupBy("path", "role").agg(F.count(F.lit(1)).alias("n"))


@register("embargo_sizes", S.query("feats", "select symbol, n, cast(ceil(n * 0.02::double) as bigint) as rows from (select symbol, count(*) as n from feats group by 1)"))
def embargo_sizes(spark, sf_dir):
    """Rows that an embargo of 2 % of a symbol's history leaves out."""
    return features(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", out_of_sample.embargo("n", 0.02))


# Overfitting.

_GRID = {f"m{k:02d}": k for k in (8, 12, 16, 26, 39)}


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A momentum backtest for each look-back."""
    raw = priced(spark, sf_dir)
    raw = raw.select("*", *[(X.safe_div(X.lag("close", 4), X.lag("close", k)) - 1).alias(f"s{c}") for c, k in _GRID.items()])
    scores = raw.select("symbol", "date", "seq", "close", *[X.zscore(f"s{c}").alias(f"s{c}") for c in _GRID])
    w = X.by_date()
    centred = scores.select("symbol", "date", "seq", "close", *[(F.col(f"s{c}") - F.avg(f"s{c}").over(w)).alias(f"c{c}") for c in _GRID])
    weights = centred.select("symbol", "date", "seq", "close", *[F.coalesce(F.try_divide(f"c{c}", F.sum(F.abs(f"c{c}")).over(w)), F.lit(0.0)).alias(c) for c in _GRID])
    return out_of_sample.grid_returns(weights, {c: c for c in _GRID})


_U = " union all ".join(f"select '{c}' as config, symbol, date, seq, close, {S.safe(S.lag('close', 4), S.lag('close', k))} - 1 as raw from panel" for c, k in _GRID.items())
S.define("sweep", "panel", _U)
_ZC = S.clip3("(raw - avg(raw) over (partition by config, date)) / (stddev_samp(raw) over (partition by config, date) + 1e-9)")
S.define("sweepw", "sweep", f"select *, coalesce(c / nullif(sum(abs(c)) over (partition by config, date), 0), 0.0) as wt from (select *, z - avg(z) over (partition by config, date) as c from (select *, {_ZC} as z from sweep))")
_CW = "partition by config, symbol order by seq"
S.define("gridret", "sweepw", f"""select config, seq, date, sum(pos * r) - sum(turn) * 0.0005 as ret from (select config, date, seq, coalesce(lag(wt, 1) over ({_CW}), 0.0) as pos, coalesce({S.safe('close', f'lag(close, 1) over ({_CW})')} - 1, 0.0) as r,
  case when row_number() over ({_CW}) = 1 then 0.0 else abs(coalesce(lag(wt, 1) over ({_CW}), 0.0) - coalesce(lag(wt, 2) over ({_CW}), 0.0)) end as turn from sweepw) group by 1, 2, 3""")
S.define("blk", "gridret", "select config, cast((seq - 1) // ((select max(seq) from gridret) // 8) as integer) as block, sum(ret) as total, sum(ret * ret) as squares, cast(count(ret) as double) as n from gridret where seq <= ((select max(seq) from gridret) // 8) * 8 group by 1, 2")


def _msh(side: str) -> str:
    t, q, n = (f"sum(case when {side} then {c} else 0.0 end)" for c in ("total", "squares", "n"))
    return f"coalesce(case when sqrt(greatest(({q} - {n} * ({t} / {n}) * ({t} / {n})) / ({n} - 1), 0.0)) >= 1e-12 then ({t} / {n}) / sqrt(greatest(({q} - {n} * ({t} / {n}) * ({t} / {n})) / ({n} - 1), 0.0)) * sqrt(52.0::double) end, 0.0)"


_IN = "(combo >> block) & 1 = 1"
S.define("cscv", "blk", f"select combo, config, {_msh(_IN)} as is_sharpe, {_msh('not (' + _IN + ')')} as oos_sharpe from blk cross join (select cast(range as integer) as combo from range(256) where bit_count(range) = 4) group by 1, 2")
S.define("logits", "cscv", f"""select *, ln(rel / (1 - rel)) as logit from (select combo, config, is_sharpe, oos_sharpe, greatest(1e-9, least(1 - 1e-9, rel)) as rel from (select *, {S.avg_rank('oos_sharpe', 'combo')} / (count(*) over (partition by combo) + 1) as rel,
  row_number() over (partition by combo order by is_sharpe desc, config) as k from cscv) where k = 1)""")


@register("pbo_block_moments", S.query("blk", f"select config, block, {S.r6('total')} as total, {S.r6('squares')} as squares, n from blk"))
def pbo_block_moments(spark, sf_dir):
    returns = grid(spark, sf_dir)
    return rounded(out_of_sample.block_moments(returns, n_bars(spark, sf_dir)))


def _logits(spark, sf_dir):
    returns = grid(spark, sf_dir)
    return out_of_sample.cscv_logits(out_of_sample.block_moments(returns, n_bars(spark, sf_dir)), ppy=PPY)


@register("cscv_logits", S.query("logits", f"select combo, config, {S.r6('is_sharpe')} as is_sharpe, {S.r6('oos_sharpe')} as oos_sharpe, {S.r6('rel')} as rel, {S.r6('logit')} as logit from logits"))
def cscv_logits(spark, sf_dir):
    return rounded(_logits(spark, sf_dir))


@register("pbo", S.query("logits", f"select count(*) as n_combinations, {S.r6('avg(cast(logit <= 0 as integer))')} as pbo, {S.r6('avg(cast(oos_sharpe < 0 as integer))')} as prob_oos_loss, {S.r6('case when max(is_sharpe) - min(is_sharpe) > 1e-9 then covar_pop(is_sharpe, oos_sharpe) / nullif(var_pop(is_sharpe), 0) end')} as slope from logits"))
def pbo(spark, sf_dir):
    return rounded(out_of_sample.pbo(_logits(spark, sf_dir)))


@register("pbo_histogram", S.query("logits", """select cast(least(19, floor((logit - lo) / (hi - lo) * 20)) as integer) as bin, count(*) as n from (select logit, case when h > l then l else l - 0.5 end as lo, case when h > l then h else h + 0.5 end as hi
  from (select logit, min(logit) over () as l, max(logit) over () as h from logits)) group by 1"""))
def pbo_histogram(spark, sf_dir):
    return out_of_sample.logit_histogram(_logits(spark, sf_dir))


# Attribution.


def _ls(score: str) -> str:
    return f"""select date, seq, avg(case when r > m - m // 3 then ret end) - avg(case when r <= m // 3 then ret end) as x from (select date, seq, ret, row_number() over (partition by date order by s, sym_pos) as r, count(*) over (partition by date) as m
      from (select *, {S.lag(score, 1)} as s from screens) where s is not null and ret is not null) where m >= 3 group by 1, 2"""


_FACTORS = {"UMD": "m12", "SMB": "(-cap)", "HML": "book_to_price", "RMW": "operating_profitability", "CMA": "(-asset_growth)"}
for _n, _s in _FACTORS.items():
    S.define(f"f{_n}", "screens", _ls(_s))
S.define("factors", "screens " + " ".join(f"f{n}" for n in _FACTORS), "select m.date, m.seq, m.MKT, " + ", ".join(f"f{n}.x as {n}" for n in _FACTORS) + " from (select date, seq, avg(ret) as MKT from screens group by 1, 2) m " + " ".join(f"left join f{n} on f{n}.seq = m.seq" for n in _FACTORS))


@register("factor_returns", S.query("factors", "select date, seq, " + ", ".join(f"{S.r6(n)} as {n}" for n in ("MKT", *_FACTORS)) + " from factors"))
def factor_returns(spark, sf_dir):
    return rounded(attribution.factor_returns(fundamental(spark, sf_dir), WEEKLY).select("date", "seq", "MKT", *_FACTORS))


@register("capm_alpha_beta", S.query("folio", f"select {S.r6('regr_slope(net, MKT)')} as beta, {S.r6('100 * regr_intercept(net, MKT)')} as alpha_pct, {S.r6('regr_r2(net, MKT)')} as r2, count(*) as n from folio join (select date, avg(ret) as MKT from panel group by 1) using (date) where MKT is not null"))
def capm_alpha_beta(spark, sf_dir):
    joined = folio(spark, sf_dir).join(priced(spark, sf_dir).groupBy("date").agg(F.avg("ret").alias("MKT")), "date").where("MKT is not null")
    beta = F.covar_pop("MKT", "net") / F.nullif(F.var_pop("MKT"), F.lit(0.0))
    r2 = F.pow(X.correlation(F.col("MKT"), F.col("net")), 2)
    return joined.agg(r6(beta).alias("beta"), r6(100 * (F.avg("net") - beta * F.avg("MKT"))).alias("alpha_pct"), r6(r2).alias("r2"), F.count(F.lit(1)).alias("n"))


@register("var_shares", S.query("folio", f"select {S.r6('regr_r2(net, MKT)')} as systematic, {S.r6('1 - regr_r2(net, MKT)')} as idiosyncratic from folio join (select date, avg(ret) as MKT from panel group by 1) using (date) where MKT is not null"))
def var_shares(spark, sf_dir):
    joined = folio(spark, sf_dir).join(priced(spark, sf_dir).groupBy("date").agg(F.avg("ret").alias("MKT")), "date")
    fit = attribution.attribution(joined, joined.select("date", "MKT"), "capm", PPY)
    share = fit.get("systematic_share")  # none under 60 bars
    return rounded(_one_row(spark, {"systematic": share and float(share), "idiosyncratic": share and float(1 - share)}, "systematic double, idiosyncratic double"))


_SIX = ("MKT", "SMB", "HML", "RMW", "CMA", "UMD")
S.define("six", "folio factors", f"select net as y, {', '.join(_SIX)} from folio join factors using (date) where net is not null and " + " and ".join(f"{f} is not null" for f in _SIX))


def _orthogonal(order: tuple[str, ...], tag: str) -> str:
    """Expressions that take each factor in turn, made orthogonal to those before, out of the outcome and of the later ones (Gram-Schmidt)."""
    steps = [f"{tag}0 as (select y as y0, y, {', '.join(order)} from six)"]
    for k, f in enumerate(order):
        slope = lambda x, f=f: f"({x} - avg({x}) over () - covar_pop({x}, {f}) over () / var_pop({f}) over () * ({f} - avg({f}) over ()))"
        later = "".join(f", {slope(g)} as {g}" for g in order[k + 1 :])
        done = "".join(f", {g}" for g in order[: k + 1])
        steps.append(f"{tag}{k + 1} as (select y0, {slope('y')} as y{done}{later} from {tag}{k})")
    return ", ".join(steps)


_LAST = {f: (*[g for g in _SIX if g != f], f) for f in _SIX}
_FF6 = S.query("six", "", ) + "".join(f", {_orthogonal(order, f'q_{f}_')}" for f, order in _LAST.items()) + " " + " union all ".join(
    f"select '{f}' as factor, {S.r6(f'covar_pop(y0, {f}) / var_pop({f})')} as beta, {S.r6(f'covar_pop(y0, {f}) / var_pop({f}) / sqrt(var_pop(y) * count(*) / (count(*) - 7) / (var_pop({f}) * count(*)))')} as t from q_{f}_6" for f in _SIX
)


@register("ff6_attribution", _FF6)
def ff6_attribution(spark, sf_dir):
    fit = attribution.attribution(folio(spark, sf_dir), attribution.factor_returns(fundamental(spark, sf_dir), WEEKLY), "ff6", PPY)
    rows = [(n, float(b), t) for n, b, t in zip(fit.get("betas", {}), fit.get("betas", {}).values(), fit.get("beta_t", {}).values(), strict=True)]
    return rounded(spark.createDataFrame(rows, "factor string, beta double, t double"))


_NESTED = S.query("six", "") + f", {_orthogonal(_SIX, 'n')} " + " union all ".join(
    f"select {k + 1} as n_factors, '{f}' as factor, count(*) as n, {S.r6(f'1 - var_pop(y) / var_pop(y0)')} as r2, {S.r6(f'covar_pop(y0, {f}) / var_pop({f})')} as beta from n{k + 1}" for k, f in enumerate(_SIX)
)


@register("nested_attribution", _NESTED)
def nested_attribution(spark, sf_dir):
    """CAPM, then a factor more at a time: variance explained, and the beta of the factor that entered last."""
    fits = attribution.nested_models(folio(spark, sf_dir), attribution.factor_returns(fundamental(spark, sf_dir), WEEKLY), _SIX, PPY)
    rows = [(len(m["factors"]), m["factors"][-1], m["n"], m["r2"], m["betas"][m["factors"][-1]]) for m in fits]
    return rounded(spark.createDataFrame(rows, "n_factors int, factor string, n long, r2 double, beta double"))


# Guards.


@register("simpson_rollup", f"""select {S.r6('pooled')} as pooled, n as n_groups, lo = hi and lo <> 0 as signs_agree, lo = hi and lo <> 0 and sign(pooled) <> lo as reversed from (select (select avg(case when o_orderstatus = 'F' then o_totalprice end) - avg(case when o_orderstatus <> 'F' then o_totalprice end) from orders) as pooled,
  count(*) as n, min(sign(e)) as lo, max(sign(e)) as hi from (select o_orderpriority, avg(case when o_orderstatus = 'F' then o_totalprice end) - avg(case when o_orderstatus <> 'F' then o_totalprice end) as e from orders group by 1))""")
def simpson_rollup(spark, sf_dir):
    orders = fixtures.read(spark, sf_dir, "orders").withColumn("treated", F.col("o_orderstatus") == "F")
    return rounded(guards.simpson(orders, "o_orderpriority", "treated", "o_totalprice"))


@register("base_rate", f"""select {S.r6('b')} as base_rate, {S.r6('t')} as tpr, {S.r6('f')} as fpr, {S.r6('t * b / (t * b + f * (1 - b))')} as precision, {S.r6('t / (t * b + f * (1 - b))')} as lift from
  (select avg(cast(event_type = 'error' as integer)) as b, avg(case when event_type = 'error' then cast(value > 100 as integer) end) as t, avg(case when event_type <> 'error' then cast(value > 100 as integer) end) as f from events)""")
def base_rate(spark, sf_dir):
    e = fixtures.read(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("event"), (F.col("value") > 100).alias("fires"))
    return rounded(guards.base_rate(e, "event", "fires"))


@register("lookahead_guard", S.query("score", f"""select {S.r6(S.corr('score', 'ret'))} as now, {S.r6(S.corr('case when r1 is not null then score end', 'case when r1 is not null then r1 end'))} as next from
  (select *, lead(ret, 1) over (partition by symbol order by seq) as r1 from score) where score is not null and ret is not null"""))
def lookahead_guard(spark, sf_dir):
    return rounded(guards.lookahead(scored(spark, sf_dir)).select("now", "next"))


@register("fat_tail", S.query("folio", f"select count(net) as n, {S.r6('skewness(net)')} as skew, {S.r6('kurtosis(net)')} as kurtosis from folio"))
def fat_tail(spark, sf_dir):
    return rounded(guards.fat_tails(folio(spark, sf_dir)).select("n", "skew", "kurtosis"))


# Ledger, audit and accounts.

_REQ_SQL = """select user_id % 8 as workspace, 'synthetic' as provider, case when value > 50 then 'momentum' else 'reversal' end as factor, case event_type when 'view' then 126.0::double when 'click' then 63.0 else 252.0 end as lookback, ' b,a ,,' || event_type as symbols from events"""
S.define("requests", "", _REQ_SQL)
_FP = """substr(sha256('{"factor":"' || factor || '","lookback":' || cast(cast(lookback as bigint) as varchar) || ',"provider":"' || provider || '","symbols":["' || array_to_string(list_sort(list_filter(list_transform(string_split(symbols, ','), lambda s: upper(trim(s))), lambda s: s <> '')), '","') || '"]}'), 1, 16)"""
S.define("trials", "requests", f"select *, {_FP} as fingerprint from requests")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.read(spark, sf_dir, "events")
    lookback = F.when(F.col("event_type") == "view", 126.0).when(F.col("event_type") == "click", 63.0).otherwise(252.0)
    requests = e.select(
        (F.col("user_id") % 8).alias("workspace"), F.lit("synthetic").alias("provider"), F.when(F.col("value") > 50, "momentum").otherwise("reversal").alias("factor"),
        lookback.alias("lookback"), F.concat(F.lit(" b,a ,,"), "event_type").alias("symbols"),
    )
    return guards.fingerprint_columns(requests, ("provider", "factor", "lookback", "symbols"))


@register("trial_fingerprint", S.query("trials", "select distinct factor, lookback, symbols, fingerprint from trials"))
def trial_fingerprint(spark, sf_dir):
    return trials(spark, sf_dir).select("factor", "lookback", "symbols", "fingerprint").distinct()


@register("ledger_floor", S.query("trials", "select workspace, count(*) as n_runs, count(distinct fingerprint) as n_distinct, greatest(count(distinct fingerprint), 4) as effective from trials group by 1"))
def ledger_floor(spark, sf_dir):
    return guards.ledger(trials(spark, sf_dir), 4)


def _chained(spark, sf_dir):
    e = fixtures.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return store.chain(e, ["user_id"], ["ts", "event_id"], F.concat_ws("|", F.col("event_id").cast("string"), "event_type"))


@register("audit_chain_fold", """with recursive e as (select user_id, event_id, event_id || '|' || event_type as body, row_number() over (partition by user_id order by ts, event_id) as k from events),
  c as (select user_id, event_id, k, sha256(repeat('0', 64) || body) as hash from e where k = 1 union all select e.user_id, e.event_id, e.k, sha256(c.hash || e.body) from c join e on e.user_id = c.user_id and e.k = c.k + 1) select user_id, event_id, hash from c""")
def audit_chain_fold(spark, sf_dir):
    return _chained(spark, sf_dir).select("user_id", "event_id", "hash")


@register("audit_verify", "select user_id, count(*) as n, not bool_or(event_id % 50 = 7) as valid from events group by 1")
def audit_verify(spark, sf_dir):
    """Chains of which some entries were changed after they were stored."""
    forged = F.when(F.col("event_id") % 50 == 7, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    return store.verify_chain(_chained(spark, sf_dir).withColumn("body", forged), ["user_id"], ["ts", "event_id"])


@register("topk_runs", "select event_id, user_id, event_type from events where user_id = 1 order by ts desc, event_id desc limit 20")
def topk_runs(spark, sf_dir):
    runs = fixtures.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("workspace_id"), F.col("ts").alias("created_at"), "event_type")
    return store.list_runs(runs, 1, 20).select(F.col("id").alias("event_id"), F.col("workspace_id").alias("user_id"), "event_type")


S.define("members", "", "select user_id, user_id % 20 as workspace_id, case event_type when 'purchase' then 'OWNER' when 'click' then 'ADMIN' when 'signup' then 'MEMBER' else 'VIEWER' end as role from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")


@register("role_authorisation", S.query("members", "select user_id, workspace_id from members where role in ('ADMIN', 'OWNER')"))
def role_authorisation(spark, sf_dir):
    e = fixtures.read(spark, sf_dir, "events")
    role = F.when(F.col("event_type") == "purchase", "OWNER").when(F.col("event_type") == "click", "ADMIN").when(F.col("event_type") == "signup", "MEMBER").otherwise("VIEWER")
    rows = e.select((F.col("user_id") % 20).alias("workspace_id"), "user_id", role.alias("role"), F.struct("ts", "event_id").alias("updated_at"))
    asked = e.select("user_id", (F.col("user_id") % 20).alias("workspace_id")).distinct()
    return store.allowed(asked, rows, "ADMIN").select("user_id", "workspace_id")


@register("bearer_principals", S.query("members", """, keys as (select event_id as id, 'sk-' || (user_id * 3) as secret, user_id % 20 as workspace_id, user_id as created_by, event_type = 'signup' as revoked from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
  asked as (select event_id, 'sk-' || (user_id * 3 + case when event_id % 10 = 0 then 1 else 0 end) as secret from events)
  select event_id, case when denied is null then user_id end as user_id, case when denied is null then workspace_id end as workspace_id, case when denied is null then role end as role, denied from (
    select a.event_id, k.created_by as user_id, k.workspace_id, m.role, case when k.id is null then 'unknown key' when k.revoked then 'revoked key' when m.role is null then 'no member' end as denied
    from asked a left join keys k using (secret) left join (select * from members where user_id % 7 <> 0) m on m.user_id = k.created_by and m.workspace_id = k.workspace_id)"""))
def bearer_principals(spark, sf_dir):
    """Callers by the secrets that they present; some present none that exists, revoked ones, or those of past members."""
    e = fixtures.read(spark, sf_dir, "events")
    role = F.when(F.col("event_type") == "purchase", "OWNER").when(F.col("event_type") == "click", "ADMIN").when(F.col("event_type") == "signup", "MEMBER").otherwise("VIEWER")
    at, secret = F.struct("ts", "event_id").alias("updated_at"), lambda n: F.concat(F.lit("sk-"), n.cast("string"))
    members = e.where("user_id % 7 <> 0").select((F.col("user_id") % 20).alias("workspace_id"), "user_id", role.alias("role"), at)
    revoked = F.when(F.col("event_type") == "signup", F.col("ts").cast("timestamp")).alias("revoked_at")
    keys = e.select(F.col("user_id").alias("id"), F.sha2(secret(F.col("user_id") * 3), 256).alias("key_hash"), (F.col("user_id") % 20).alias("workspace_id"), F.col("user_id").alias("created_by"), revoked, at)
    asked = e.select("event_id", secret(F.col("user_id") * 3 + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).alias("secret"))
    return store.principals(asked, keys, members)


@register("account_commits", """with c as (select distinct event_id // 40 as batch from events where event_id // 40 % 7 <> 3), live as (select * from c where not (batch % 11 = 5 and batch + 1 in (select batch from c))),
  rows as (select user_id, event_type, event_id, case when event_id // 40 % 11 = 6 and event_id % 40 < 5 then event_id // 40 - 1 else event_id // 40 end as version, event_id // 40 as batch from events)
  select user_id, event_type, event_id, version from rows join live using (batch) qualify row_number() over (partition by user_id order by version desc, event_id desc) = 1""")
def account_commits(spark, sf_dir):
    """The latest state of users from batches of rows: some batches have no commit, some gave way to the next one, some rows kept their age."""
    e = fixtures.read(spark, sf_dir, "events")
    batch = F.floor(F.col("event_id") / 40).cast("long")
    kept = F.when((batch % 11 == 6) & (F.col("event_id") % 40 < 5), batch - 1)
    rows = e.select("user_id", "event_type", "event_id", batch.cast("string").alias("batch"), kept.alias("kept_version"))
    gone = F.when(F.col("version") % 11 == 6, F.array(F.struct(F.lit("members").alias("of"), (F.col("version") - 1).cast("string").alias("batch"))))
    commits = e.select(batch.alias("version")).distinct().where("version % 7 <> 3").select("version", F.col("version").cast("string").alias("batch"), gone.alias("removed"))
    state = store.latest(accounts.committed(rows, commits, "members").withColumn("order", F.struct("version", "event_id")), ["user_id"], "order")
    return state.select("user_id", "event_type", "event_id", "version")


_LOG = "list_filter(c.log, lambda x: x > e.ts - interval 1 day)"


@register("rate_limiter", f"""with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events),
  c as (select user_id, event_id, ts, k, true as admitted, [ts] as log from e where k = 1 union all select e.user_id, e.event_id, e.ts, e.k, len({_LOG}) < 10, case when len({_LOG}) < 10 then list_append({_LOG}, e.ts) else {_LOG} end from c join e on e.user_id = c.user_id and e.k = c.k + 1)
  select user_id, event_id, ts, admitted from c""")
def rate_limiter(spark, sf_dir):
    return streams.rate_limited(fixtures.read(spark, sf_dir, "events"), 10, 86_400.0).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Text.


@register("signal_validation_rejects", "select event_id from events where not (value / 100 - 1 between -1 and 1 and event_type <> 'error')")
def signal_validation_rejects(spark, sf_dir):
    e = fixtures.read(spark, sf_dir, "events")
    raw = F.concat(F.lit('noise {"guidance_change": 0, "tone": '), (F.col("value") / 100 - 1).cast("string"), F.lit(', "reason": "'), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")), F.lit('"} end'))
    return e.select("event_id", text_signals.parse_signal(raw).alias("signal")).where(~text_signals.is_valid()).select("event_id")


@register("llm_cache_misses", "select distinct sha256(coalesce(text, '')) as text_sha from documents where sha256(coalesce(text, '')) not in (select sha256(coalesce(text, '')) from documents where doc_id % 3 = 0)")
def llm_cache_misses(spark, sf_dir):
    docs = fixtures.read(spark, sf_dir, "documents")
    cache = docs.where("doc_id % 3 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"))
    return text_signals.cache_misses(docs, cache)


# Windowed events (the batch forms of the streaming operators).


@register("events_tumbling", f"select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, {S.r6('sum(value)')} as total from events group by 1, 2")
def events_tumbling(spark, sf_dir):
    out = streams.windowed_counts(fixtures.read(spark, sf_dir, "events"))
    return rounded(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("events_sliding", f"select b - to_minutes(30 * k) as start, event_type, count(*) as n, {S.r6('sum(value)')} as total from (select *, time_bucket(interval 30 minute, ts) as b, unnest([0, 1]) as k from events) group by 1, 2")
def events_sliding(spark, sf_dir):
    out = streams.windowed_counts(fixtures.read(spark, sf_dir, "events"), "1 hour", "30 minutes")
    return rounded(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("events_session", """select user_id, min(ts) as start, max(ts) + interval 30 minute as finish, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as s from
  (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events)) group by user_id, s""")
def events_session(spark, sf_dir):
    out = streams.sessions(fixtures.read(spark, sf_dir, "events"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "finish")})


@register("late_dedup", "select distinct user_id, event_type from events")
def late_dedup(spark, sf_dir):
    return streams.first_seen(fixtures.read(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@register("asof_events", """select p.event_id, p.user_id, p.ts, c.ts as click_ts, c.event_id as click_event_id, round(c.value, 6) + 0.0 as click_value from (select * from events where event_type = 'purchase') p
  asof left join (select * from events where event_type = 'click' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1) c on p.user_id = c.user_id and p.ts >= c.ts""")
def asof_events(spark, sf_dir):
    """Each purchase with the user's last click at or before it."""
    e = fixtures.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kind = lambda k: e.where(F.col("event_type") == k).select("event_id", "user_id", "ts", "value")
    joined = asof.asof_join(kind("purchase").drop("value"), kind("click"), ["user_id"], "ts", values=["event_id", "value"], order=["event_id"], prefix="click_")
    return joined.withColumn("click_value", r6("click_value"))


@register("asof_tolerance", """select p.event_id, p.user_id, case when c.ts >= p.ts - interval 6 hour then c.event_id end as click_event_id from (select * from events where event_type = 'purchase') p
  asof left join (select * from events where event_type = 'click' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1) c on p.user_id = c.user_id and p.ts >= c.ts""")
def asof_tolerance(spark, sf_dir):
    """The same within six hours."""
    e = fixtures.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kind = lambda k: e.where(F.col("event_type") == k).select("event_id", "user_id", "ts")
    return asof.asof_join(kind("purchase"), kind("click"), ["user_id"], "ts", order=["event_id"], tolerance="6 hours", prefix="click_").select("event_id", "user_id", "click_event_id")


@register("ledger_epochs", """with e as (select user_id % 20 as workspace, ts, event_id, event_type, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id % 20 order by ts, case when event_type = 'signup' then 0 else 1 end, event_id) as k, user_id from events),
  t as (select workspace, k, event_type || '|' || (user_id // 20 % 5) as fingerprint from e where event_type <> 'signup')
  select workspace, epoch, count(*) as n_runs, count(distinct fingerprint) as n_distinct, greatest(count(distinct fingerprint), 4) as effective from (select t.workspace, c.event_id as epoch, fingerprint from t left join (select workspace, k, max(event_id) as event_id from e where event_type = 'signup' group by 1, 2) c
  on c.workspace = t.workspace and c.k = t.k) group by 1, 2""")
def ledger_epochs(spark, sf_dir):
    """Trials of a workspace since its last reset, which is an event like they are."""
    e = fixtures.read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("workspace"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", F.concat_ws("|", "event_type", F.floor(F.col("user_id") / 20) % 5).alias("fingerprint"))
    return guards.ledger_epochs(e.where("event_type <> 'signup'"), e.where("event_type = 'signup'"), 4, order="event_id")


# Models (rows only: iterative fits).


def _soft(rest: str, g: str) -> str:
    """One coordinate's minimum for the penalty 0.001 at half L1."""
    return f"sign({rest}) * greatest(abs({rest}) - 0.0005, 0.0) / ({g} + 0.0005)"


_ENET = S.query("feats", "").replace("with ", "with recursive ", 1) + f""", c as (select covar_pop(x1, x1) as g11, covar_pop(x1, x2) as g12, covar_pop(x1, x3) as g13, covar_pop(x2, x2) as g22, covar_pop(x2, x3) as g23, covar_pop(x3, x3) as g33,
    covar_pop(x1, y) as t1, covar_pop(x2, y) as t2, covar_pop(x3, y) as t3 from (select y, coalesce(x1, 0.0) as x1, coalesce(x2, 0.0) as x2, coalesce(x3, 0.0) as x3 from feats)),
  rounds as (select 0 as k, 0.0::double as w1, 0.0::double as w2, 0.0::double as w3 union all
    select k + 1, a1, a2, {_soft('(t3 - g13 * a1 - g23 * a2)', 'g33')} from (select *, {_soft('(t2 - g12 * a1 - g23 * w3)', 'g22')} as a2 from (select *, {_soft('(t1 - g12 * w2 - g13 * w3)', 'g11')} as a1 from rounds cross join c)) where k < 200)
  select 'x1' as feature, {S.r6('w1')} as coefficient from rounds where k = 200 union all select 'x2', {S.r6('w2')} from rounds where k = 200 union all select 'x3', {S.r6('w3')} from rounds where k = 200"""


@register("elastic_net_fit", _ENET)
def elastic_net_fit(spark, sf_dir):
    from ..operators.models import make_model

    names = ["x1", "x2", "x3"]
    fit = make_model("elastic_net")(features(spark, sf_dir), names)
    return rounded(spark.createDataFrame(list(zip(names, fit.coefficients, strict=True)), "feature string, coefficient double"))


#: Trees, rounds and passes of the registered comparison, fewer than the library's defaults.
LADDER = {"random_forest": {"trees": 40}, "xgboost": {"rounds": 20}, "lightgbm": {"rounds": 20}, "stacking": {"rounds": 10}, "mlp": {"epochs": 10}}


@contextmanager
def _written(df, name):
    """``df`` as a table in the shared folder, removed at the end.

    Each task over a cached plan sends the driver the metrics of all its steps, some 30 kB, in every one of the models' many
    jobs, which have a task for each of the plan's partitions; tasks over files send some 2 kB and are as many as the bytes need.
    """
    table = Written(df, name)
    try:
        yield table.df
    finally:
        table.remove()


@register("ladder_leaderboard")
def ladder_leaderboard(spark, sf_dir):
    """All seven models over six purged folds."""
    from ..operators.models import compare

    with _written(features(spark, sf_dir), "features") as rows, _written(out_of_sample.purged_folds(rows, None, 6, 0.01), "folds") as folds:
        board = compare(folds, ["x1", "x2", "x3"], 6, ppy=PPY, options=LADDER)["leaderboard"]
    return spark.createDataFrame([(r["model"], r["rank_ic"], r["long_short_sharpe"], r["n_dates"]) for r in board], "model string, rank_ic double, long_short_sharpe double, n_dates long")


def _folds6(spark, sf_dir):
    """Six purged folds as a table in the shared folder; it stays, as results read it."""
    return Written(out_of_sample.purged_folds(features(spark, sf_dir), None, 6, 0.01), "folds").df


@register("boosted_oof")
def boosted_oof(spark, sf_dir):
    """Out-of-fold predictions of level-wise and leaf-wise boosting over six purged folds."""
    from ..operators.models import make_model, out_of_fold

    folds, names = _folds6(spark, sf_dir), ["x1", "x2", "x3"]
    parts = [out_of_fold(folds, make_model(m, rounds=10, gamma=0.0, l1=0.0), names, 6).select(F.lit(m).alias("model"), "fold", "row", r6("prediction").alias("prediction")) for m in ("xgboost", "lightgbm")]
    return parts[0].unionByName(parts[1])


@register("stacking_oof")
def stacking_oof(spark, sf_dir):
    """The bases' predictions for training rows that they did not learn from, by fold."""
    from ..operators.models import make_model

    train = _folds6(spark, sf_dir).where("role = 'train'")
    rows = make_model("stacking", rounds=5, l1=0.0).out_of_fold(train, ["x1", "x2", "x3"], "fold")
    return rows.select("fold", "row", r6("_en").alias("elastic_net"), r6("_gbt").alias("boosted"), r6("y").alias("y"))


_F6 = "case " + " ".join(f"when row < (select count(*) from feats) * {k + 1} // 6 then {k}" for k in range(5)) + " else 5 end"
S.define("spans6", "feats", _SPANS.format(f=_F6))
S.define("train6", "spans6", """select p.fold, coalesce(f.x1, 0.0) as x1, coalesce(f.x2, 0.0) as x2, coalesce(f.x3, 0.0) as x3, f.y from feats f cross join spans6 p where not f.row between p.lo and p.hi
  and (f.label_end < p.s or f.label_start > p.e) and not (f.row > p.hi and f.row <= p.hi + ceil((select count(*) from feats) * 0.01::double))""")
_COV = ", ".join(f"covar_pop(x{i}, x{j}){' + 1.0 / count(*)' if i == j else ''} as c{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))


def _det(columns: list[str]) -> str:
    """A 3 x 3 determinant whose column k is named by ``columns[k]`` and a row's number."""
    a, b, c = columns
    return f"({a}1 * ({b}2 * {c}3 - {b}3 * {c}2) - {b}1 * ({a}2 * {c}3 - {a}3 * {c}2) + {c}1 * ({a}2 * {b}3 - {a}3 * {b}2))"


_W = ", ".join(f"{_det(['d' if k == i else f'c{k}' for k in (1, 2, 3)])} / {_det(['c1', 'c2', 'c3'])} as w{i}" for i in (1, 2, 3))


@register("fold_ridge", S.query("train6", f"""select fold, n, {', '.join(S.r6(f'w{i}') + f' as w{i}' for i in (1, 2, 3))}, {S.r6('my - w1 * m1 - w2 * m2 - w3 * m3')} as intercept from (select fold, n, my, m1, m2, m3, {_W} from (
  select fold, count(*) as n, avg(y) as my, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, {_COV}, covar_pop(x1, y) as d1, covar_pop(x2, y) as d2, covar_pop(x3, y) as d3 from train6 group by 1))"""))
def fold_ridge(spark, sf_dir):
    """A ridge of each fold from one aggregate of all rows and one of what the folds leave out."""
    rows, names = features(spark, sf_dir).persist(), ["x1", "x2", "x3"]
    left_out = linear_folds.products(out_of_sample.left_out(rows, None, 6, 0.01), names, "fold")
    trained = linear_folds.without(linear_folds.products(rows, names)[0], left_out)
    fits = [(g, int(round(p.n)), *map(float, linear_folds.ridge(p, 1.0))) for g, p in sorted(trained.items())]
    rows.unpersist()
    out = spark.createDataFrame(fits, "fold int, n long, w1 double, w2 double, w3 double, intercept double")
    return rounded(out)
