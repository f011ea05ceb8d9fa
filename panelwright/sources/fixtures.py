"""The engine's data model made from sales tables: brands are symbols, order weeks are bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.factors import EXTRA_METRICS, METRICS
from .panel import calendar_of, densify, forward_fill


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, raw, volume): volume-weighted price of a brand in a week."""
    sales = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    week = F.date_trunc("week", "l_shipdate").cast("date")
    return sales.groupBy(F.col("p_brand").alias("symbol"), week.alias("date")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("raw"), F.sum("l_quantity").alias("volume")
    )


def weekly_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weeks from the first to the last sale; one column is read, and only its bounds are shuffled."""
    sold = read(spark, sf_dir, "lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
    return calendar_of(sold)


def dense_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full grid with raw prices carried forward and volume 0 where nothing was sold."""
    weeks = brand_weeks(spark, sf_dir)
    grid = densify(weeks, weekly_calendar(spark, sf_dir)).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return forward_fill(grid, "raw")


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sym_pos, date, seq, volume, close, ret): a price path chained from past-only deviations."""
    upto = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    deviation = F.col("raw") / F.avg("raw").over(upto) - 1
    panel = dense_prices(spark, sf_dir).withColumn("dev", F.when(deviation.isNull(), 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), deviation))))
    panel = panel.withColumn("close", 100 * F.product(1 + 0.1 * F.col("dev")).over(upto)).drop("raw", "dev")
    before = F.lag("close", 1).over(Window.partitionBy("symbol").orderBy("seq"))
    return panel.withColumn("ret", F.col("close") / before - 1)


#: Metric -> what it sums over a brand's sales of a quarter.
QUARTER_SUMS = {
    "revenue": "l_extendedprice*(1-l_discount)", "cogs": "l_extendedprice*(1-l_discount)*(0.4+2*l_discount)",
    "gross_profit": "l_extendedprice*(1-l_discount)*(0.6-2*l_discount)", "sga": "l_extendedprice*l_tax", "rnd": "l_extendedprice*l_tax*0.2",
    "ebit": "l_extendedprice*((1-l_discount)*(0.6-2*l_discount)-1.2*l_tax)", "interest_expense": "l_quantity*20",
    "net_income": "l_extendedprice*(0.2-0.05*l_linenumber)", "shares_diluted": "l_quantity", "total_assets": "l_extendedprice*3",
    "current_assets": "l_extendedprice*(case when l_linestatus='O' then 1.5 else 1.0 end)", "cash": "l_extendedprice*0.4",
    "receivables": "l_extendedprice*(case when l_linestatus='O' then 0.4 else 0.2 end)", "inventory": "l_extendedprice*0.3",
    "current_liabilities": "l_extendedprice*(case when l_returnflag='R' then 0.9 else 0.5 end)", "accounts_payable": "l_extendedprice*0.2",
    "current_debt": "l_extendedprice*0.3*l_tax*10", "long_term_debt": "l_extendedprice*l_tax*10", "total_liabilities": "l_extendedprice*(1.2+4*l_tax)",
    "common_equity": "l_extendedprice*(1.8-4*l_tax)", "retained_earnings": "l_extendedprice*(0.5+l_discount)",
    "op_cash_flow": "l_extendedprice*(case when l_returnflag='A' then 0.35 else 0.25 end)", "capex": "l_extendedprice*0.06",
    "ppe_net": "l_extendedprice*(1.0+l_discount)", "depreciation": "l_extendedprice*(0.02+0.1*l_tax)",
    "securities": "l_extendedprice*0.1*(case when l_returnflag='N' then 1 else 0 end)", "taxes_payable": "l_extendedprice*0.02",
    "income_cont_ops": "l_extendedprice*(0.2-0.05*l_linenumber)", "short_term_debt": "l_extendedprice*0.3*l_tax*10",
}


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, period_end, one column a metric)."""
    sales = (
        read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    end = F.expr("cast(date_trunc('quarter', o_orderdate) + interval '3' month - interval '1' day as date)")
    return sales.groupBy(F.col("p_brand").alias("symbol"), end.alias("period_end")).agg(*[F.expr(f"sum({QUARTER_SUMS[m]})").cast("double").alias(m) for m in (*METRICS, *EXTRA_METRICS)])


def observations(spark: SparkSession, sf_dir: str, lag_days: int = 75) -> DataFrame:
    """Quarterly metrics as observations known ``lag_days`` after the quarter's end."""
    wide = quarters(spark, sf_dir).withColumn("available_date", F.date_add("period_end", lag_days))
    return wide.unpivot(["symbol", "period_end", "available_date"], [*METRICS, *EXTRA_METRICS], "metric", "value")
