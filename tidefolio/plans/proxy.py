"""A daily-panel shape derived from the order tables.

A supplier is a code, a ship month a date, a nation an industry. All sums are
over whole quantities or whole cents, so they do not depend on the order of
the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidefolio.functions import fixed as K
from tidefolio.operators.calendar import trading_calendar
from tidefolio.session import cut_lineage

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_of(column: str):
    return F.trunc(F.col(column).cast("date"), "MM")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxy panel, one row per (code, month) that had shipments."""
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
    hundredths = F.rint(F.col("l_discount") * 100).cast("long")
    # one hot supplier is summed in the map tasks before it is shuffled
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", month_of("l_shipdate").alias("date"))
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.coalesce(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))), F.lit(0.0)).alias("qty_n"),
            F.sum(cents).cast("double").alias("cents"),
            F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
            (F.sum(hundredths).cast("double") / 100.0 / F.count(F.lit(1))).alias("discount"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    by_code = Window.partitionBy("l_suppkey").orderBy("date")
    first = Window.partitionBy("l_suppkey")
    prev_month = F.lag("date").over(by_code) == F.add_months("date", -1)
    key = F.col("l_suppkey")
    priced = cells.withColumn("pre_close", F.when(prev_month, F.lag("close").over(by_code))).withColumn(
        "first_date", F.min("date").over(first)
    )
    total_mv = F.col("qty") * 10.0
    vwap = F.col("cents") / 100.0 / F.col("qty")
    named = priced.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )
    return named.select(
        F.concat(
            F.lpad(key.cast("string"), 6, "0"), F.when(key % 10 == 0, ".BJ").otherwise(".SZ")
        ).alias("code"),
        "date",
        F.col("s_name").alias("name"),
        "pre_close",
        "close",
        (F.col("pre_close") * 1.1).alias("limit_up"),
        (F.col("pre_close") * 0.9).alias("limit_down"),
        F.col("qty").alias("volume"),
        (F.col("cents") / 100000.0).alias("amount"),
        F.col("close").alias("adj_close"),
        vwap.alias("adj_vwap"),
        F.lit(1.0).alias("adj_factor"),
        F.when(F.col("lines") <= 2, K.HALTED).otherwise(K.TRADING).alias("trade_status"),
        vwap.alias("vwap"),
        total_mv.alias("total_mv"),
        (total_mv * (1.0 - F.col("discount"))).alias("float_mv"),
        (total_mv * F.col("qty_n") / F.col("qty")).alias("free_mv"),
        F.col("n_name").alias("industry_l1"),
        F.date_format("first_date", "yyyyMMdd").alias("list_date"),
        F.datediff("date", "first_date").alias("list_days"),
        F.lit("20991231").alias("delist_date"),
        F.when((key % 3 == 0) & (F.month("date") != 5), 1).otherwise(0).alias("is_hs300"),
        F.when(key % 3 == 1, 1).otherwise(0).alias("is_zz500"),
        F.when(key % 3 == 2, 1).otherwise(0).alias("is_zz1000"),
        F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("is_st"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's dates, read from the one column that holds them."""
    return trading_calendar(table(spark, sf_dir, "lineitem").select(month_of("l_shipdate").alias("date")))


def codes(spark: SparkSession, sf_dir: str) -> int:
    """Upper bound of the names on one date, counted from file footers."""
    return table(spark, sf_dir, "supplier").count()


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Panel, calendar and the bound of names per date."""
    return panel(spark, sf_dir), calendar(spark, sf_dir), codes(spark, sf_dir)


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """As load(), with the panel written once because the query reads it several times."""
    rows = cut_lineage(panel(spark, sf_dir))
    return rows, cut_lineage(trading_calendar(rows)), codes(spark, sf_dir)
