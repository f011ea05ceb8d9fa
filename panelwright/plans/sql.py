"""Independent SQL for each registered query, as common table expressions over the driver's tables."""

from __future__ import annotations

from ..functions.factors import EXTRA_METRICS, METRICS
from ..sources.fixtures import QUARTER_SUMS

#: name -> (names it builds on, body)
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, needs: str, body: str) -> None:
    CTE[name] = (tuple(needs.split()), body)


def query(needs: str, select: str) -> str:
    """``select`` preceded by the expressions it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTE[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    return ("with " + ",\n".join(f"{n} as ({CTE[n][1]})" for n in order) + "\n" if order else "") + select


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def safe(a: str, b: str) -> str:
    return f"(case when abs({b}) > 1e-12 then ({a}) / ({b}) end)"


def clip3(x: str) -> str:
    return f"(case when ({x}) is not null then greatest(-3.0, least(3.0, {x})) end)"


def z(x: str) -> str:
    return clip3(f"({x} - avg({x}) over (partition by date)) / (stddev_samp({x}) over (partition by date) + 1e-9)")


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) over (partition by symbol order by seq)"


def corr(x: str, y: str) -> str:
    return f"case when stddev_pop({x}) * stddev_pop({y}) > 1e-12 then covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) end"


define("px", "", """select p_brand as symbol, cast(date_trunc('week', l_shipdate) as date) as date, sum(l_extendedprice) / sum(l_quantity) as raw, sum(l_quantity) as volume
  from lineitem join part on l_partkey = p_partkey group by 1, 2""")
define("cal", "px", """select cast(d as date) as date, cast(row_number() over (order by d) as integer) as seq
  from (select unnest(generate_series((select min(date) from px), (select max(date) from px), interval 7 day)) as d)""")
define("sym", "px", "select symbol, cast(row_number() over (order by symbol) as integer) as sym_pos from (select distinct symbol from px)")
define("grid", "px cal sym", """select s.symbol, s.sym_pos, c.date, c.seq, p.raw as vwap, coalesce(p.volume, 0.0) as volume
  from sym s cross join cal c left join px p on p.symbol = s.symbol and p.date = c.date""")
define("filled", "grid", "select *, last_value(vwap ignore nulls) over (partition by symbol order by seq rows between unbounded preceding and current row) as raw from grid")
define("dev", "filled", "select *, raw / avg(raw) over (partition by symbol order by seq rows between unbounded preceding and current row) - 1 as d0 from filled")
define("path", "dev", """select symbol, sym_pos, date, seq, volume, 100 * product(1 + 0.1 * (case when d0 is null then 0.0 else greatest(-0.5, least(0.5, d0)) end))
  over (partition by symbol order by seq rows between unbounded preceding and current row) as close from dev""")
define("panel", "path", f"select *, close / {lag('close', 1)} - 1 as ret from path")
define("quarters", "", f"""select p_brand as symbol, cast(date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day as date) as period_end,
  {', '.join(f'cast(sum({QUARTER_SUMS[m]}) as double) as {m}' for m in (*METRICS, *EXTRA_METRICS))}
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey group by 1, 2""")
define("placed", "quarters cal", "select q.*, (select min(seq) from cal where cal.date >= q.period_end + 75) as bar from quarters q")
define("pit", "placed panel", f"""select symbol, sym_pos, date, seq, volume, close, ret, {', '.join(f"last_value({m} ignore nulls) over w as {m}" for m in (*METRICS, *EXTRA_METRICS))}
  from (select p.*, {', '.join(f'f.{m}' for m in (*METRICS, *EXTRA_METRICS))} from panel p left join
    (select * from placed qualify row_number() over (partition by symbol, bar order by period_end desc) = 1) f on f.symbol = p.symbol and f.bar = p.seq)
  window w as (partition by symbol order by seq rows between 80 preceding and current row)""")

MCAP = "(close * shares_diluted)"
LEVEL = {
    "gross_profitability": safe("revenue - cogs", "total_assets"), "operating_profitability": safe("revenue - cogs - sga - interest_expense", "common_equity"),
    "roa": safe("net_income", "total_assets"), "roe": safe("net_income", "common_equity"), "gross_margin": safe("revenue - cogs", "revenue"),
    "operating_margin": safe("ebit", "revenue"), "asset_turnover": safe("revenue", "total_assets"), "earnings_yield": safe("net_income", MCAP),
    "book_to_price": safe("common_equity", MCAP), "sales_to_price": safe("revenue", MCAP), "fcf_yield": safe("op_cash_flow - capex", MCAP),
    "leverage": safe("current_debt + long_term_debt", "total_assets"), "current_ratio": safe("current_assets", "current_liabilities"),
    "sloan_accruals": safe("net_income - op_cash_flow", "total_assets"), "ebit_to_ev": safe("ebit", f"({MCAP} + current_debt + long_term_debt - cash)"),
    "altman_z": f"1.2 * {safe('current_assets - current_liabilities', 'total_assets')} + 1.4 * {safe('retained_earnings', 'total_assets')} + 3.3 * {safe('ebit', 'total_assets')} + 0.6 * {safe(MCAP, 'total_liabilities')} + {safe('revenue', 'total_assets')}",
}
YEARLY = "total_assets shares_diluted net_income long_term_debt current_assets current_liabilities gross_profit revenue receivables ppe_net securities depreciation sga".split()
define("yearly", "pit", "select *, " + ", ".join(f"{lag(m, 52 * k)} as {m}_{k}" for m in YEARLY for k in (1, 2)) + " from pit")


def _avg2(a: str, b: str) -> str:
    return f"coalesce(({a} + {b}) / 2, {a}, {b})"


_TESTS = [
    f"{safe('net_income', 'total_assets_1')} > 0",
    f"{safe('op_cash_flow', 'total_assets_1')} > 0",
    f"{safe('net_income', 'total_assets_1')} - {safe('net_income_1', 'total_assets_2')} > 0",
    f"{safe('op_cash_flow', 'total_assets_1')} > {safe('net_income', 'total_assets_1')}",
    f"{safe('long_term_debt', _avg2('total_assets', 'total_assets_1'))} - {safe('long_term_debt_1', _avg2('total_assets_1', 'total_assets_2'))} < 0",
    f"{safe('current_assets', 'current_liabilities')} - {safe('current_assets_1', 'current_liabilities_1')} > 0",
    "shares_diluted - shares_diluted_1 <= 0",
    f"{safe('gross_profit', 'revenue')} - {safe('gross_profit_1', 'revenue_1')} > 0",
    f"{safe('revenue', 'total_assets_1')} - {safe('revenue_1', 'total_assets_2')} > 0",
]
LAGGED = {
    "asset_growth": safe("total_assets - total_assets_1", "total_assets_1"),
    "net_equity_issuance": f"case when {safe('shares_diluted', 'shares_diluted_1')} > 0 then ln({safe('shares_diluted', 'shares_diluted_1')}) end",
    "piotroski_f": f"case when {' + '.join(f'(case when ({t}) is null then 0 else 1 end)' for t in _TESTS)} >= 7 then {' + '.join(f'(case when {t} then 1.0::double else 0.0 end)' for t in _TESTS)} end",
    "ohlson_o": f"""-1.32 - 0.407 * (case when total_assets > 0 then ln(total_assets) end) + 6.03 * {safe('total_liabilities', 'total_assets')} - 1.43 * {safe('current_assets - current_liabilities', 'total_assets')}
      + 0.0757 * {safe('current_liabilities', 'current_assets')} - 1.72 * cast(total_liabilities > total_assets as double) - 2.37 * {safe('net_income', 'total_assets')} - 1.83 * {safe('op_cash_flow', 'total_liabilities')}
      + 0.285 * cast(net_income < 0 and net_income_1 < 0 as double) - 0.521 * {safe('net_income - net_income_1', '(abs(net_income) + abs(net_income_1))')}""",
    "beneish_m": f"""-4.84 + 0.92 * {safe(safe('receivables', 'revenue'), safe('receivables_1', 'revenue_1'))} + 0.528 * {safe(safe('gross_profit_1', 'revenue_1'), safe('gross_profit', 'revenue'))}
      + 0.404 * {safe('1 - ' + safe('current_assets + ppe_net + securities', 'total_assets'), '(1 - ' + safe('current_assets_1 + ppe_net_1 + securities_1', 'total_assets_1') + ')')} + 0.892 * {safe('revenue', 'revenue_1')}
      + 0.115 * {safe(safe('depreciation_1', '(depreciation_1 + ppe_net_1)'), safe('depreciation', '(depreciation + ppe_net)'))} - 0.172 * {safe(safe('sga', 'revenue'), safe('sga_1', 'revenue_1'))}
      + 4.679 * {safe('income_cont_ops - op_cash_flow', 'total_assets')} - 0.327 * {safe(safe('current_liabilities + long_term_debt', 'total_assets'), safe('current_liabilities_1 + long_term_debt_1', 'total_assets_1'))}""",
}
_vol = "case when count(ret) over (partition by symbol order by seq rows between 12 preceding and current row) >= 13 then stddev_samp(ret) over (partition by symbol order by seq rows between 12 preceding and current row) * sqrt(52.0::double) end"
define("priced", "panel", f"""select *, {safe(lag('close', 4), lag('close', 26))} - 1 as momentum, {safe(lag('close', 4), lag('close', 52))} - 1 as momentum_12_1, {_vol} as trailing_volatility,
  -({safe('close', lag('close', 4))} - 1) as short_term_reversal, {safe('abs(ret)', 'close * volume')} as impact from panel""")
define("screens", "yearly priced", "select y.symbol, y.sym_pos, y.date, y.seq, y.close, y.ret, " + ", ".join(f"{x} as {n}" for n, x in {**LEVEL, **LAGGED}.items()) + ", trailing_volatility, momentum_12_1 as m12, close * shares_diluted as cap from yearly y join (select symbol, seq, trailing_volatility, momentum_12_1 from priced) p using (symbol, seq)")
define("score", "priced", f"select symbol, sym_pos, date, seq, close, ret, {z('momentum')} as score from priced")
define("weights", "score", """select *, coalesce(c / nullif(sum(abs(c)) over (partition by date), 0), 0.0) as weight from (select *, score - avg(score) over (partition by date) as c from score)""")
define("held", "weights", f"""select *, coalesce({lag('weight', 1)}, 0.0) as pos, coalesce({safe('close', lag('close', 1))} - 1, 0.0) as r,
  case when row_number() over (partition by symbol order by seq) = 1 then 0.0 else abs(coalesce({lag('weight', 1)}, 0.0) - coalesce({lag('weight', 2)}, 0.0)) end as turn from weights""")
define("folio", "held", "select date, seq, sum(pos * r) as gross, sum(turn) as turnover, sum(abs(pos)) as book, sum(pos * r) - sum(turn) * 0.0005 as net from held group by 1, 2")
define("curve", "folio", "select *, product(1 + net) over w as equity from folio window w as (order by seq rows between unbounded preceding and current row)")
define("peaked", "curve", "select *, max(equity) over (order by seq rows between unbounded preceding and current row) as peak from curve")
define("fwd", "score", "select *, " + safe("lead(close, 1) over (partition by symbol order by seq)", "close") + " - 1 as fwd from score")
define("paired", "fwd", "select * from fwd where score is not null and fwd is not null")


def avg_rank(x: str, part: str) -> str:
    x = f"round({x}, 12)"
    return f"(rank() over (partition by {part} order by {x}) + (count(*) over (partition by {part}, {x}) - 1) / 2.0::double)"


define("ic", "paired", f"""select * from (select date, seq, {corr('a', 'b')} as ic, count(*) as n from (select date, seq, {avg_rank('score', 'date')} as a, {avg_rank('fwd', 'date')} as b from paired) group by 1, 2)
  where n >= 5 and ic is not null""")
