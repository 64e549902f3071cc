"""Risk tables and alpha scores derived from the proxy panel.

Three styles are z-scores of traded quantity, traded value and average price;
their covariance is that of the day's cross-section, other factors have a
diagonal. Risk dates are every second month from the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import ratio
from tidefolio.operators.calendar import at_offset, with_day
from tidefolio.operators.crosssection import zscore
from tidefolio.operators.risk import exposure_panel, style_exposures

STYLES = {"Size": "volume", "Liquidity": "amount", "Value": "vwap"}
COUNTRY_VAR = 0.0004
INDUSTRY_VAR = 0.0001


def style_scores(panel: DataFrame, max_rows: int | None) -> DataFrame:
    """(date, code, factor, zscore, univ_flag); suspended names are outside the universe."""
    rows = panel.select(
        "date", "code", "trade_status",
        F.log("volume").alias("Size"), F.log("amount").alias("Liquidity"), F.col("vwap").alias("Value"),
    )
    for name in STYLES:
        rows = zscore(rows, name, name, max_rows=max_rows)
    long = rows.unpivot(["date", "code", "trade_status"], list(STYLES), "factor", "zscore")
    flag = F.when(F.col("trade_status") == K.HALTED, 0).otherwise(1)
    return long.select("date", "code", "factor", "zscore", flag.alias("univ_flag"))


def risk_days(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Panel rows on the risk dates."""
    picked = calendar.where((F.col("day") >= 2) & (F.col("day") % 2 == 0)).select("date")
    return panel.join(F.broadcast(picked), "date", "left_semi")


def exposures(panel: DataFrame, calendar: DataFrame, max_rows: int | None) -> DataFrame:
    rows = risk_days(panel, calendar)
    return exposure_panel(style_exposures(style_scores(rows, max_rows)), rows)


def specific(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Variance of the returns so far, unknown below three."""
    so_far = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ret = ratio(F.col("adj_close"), at_offset("adj_close", -1)) - 1
    rows = with_day(panel.select("date", "code", "adj_close"), calendar).withColumn("_ret", ret)
    var = F.when(F.count("_ret").over(so_far) >= 3, F.var_samp("_ret").over(so_far))
    dated = rows.withColumn("spec_var", var)
    return risk_days(dated, calendar).select(F.col("date").alias("rebal_date"), "code", "spec_var")


def covariance(exposures: DataFrame) -> DataFrame:
    """Style covariance of each date, one orientation; constants for the others."""
    style = exposures.where(F.col("factor").isin(*STYLES)).groupBy("rebal_date", "code").pivot("factor", list(STYLES)).agg(F.sum("x"))
    pairs = [(a, b) for i, a in enumerate(STYLES) for b in list(STYLES)[i:]]
    wide = style.groupBy("rebal_date").agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cov = wide.unpivot("rebal_date", [F.col(f"`{a}|{b}`") for a, b in pairs], "_pair", "cov").select(
        "rebal_date",
        F.split("_pair", r"\|")[0].alias("factor_i"),
        F.split("_pair", r"\|")[1].alias("factor_j"),
        (F.col("cov") * 0.001).alias("cov"),
    )
    rest = exposures.where(~F.col("factor").isin(*STYLES)).select("rebal_date", "factor").distinct()
    diagonal = rest.select(
        "rebal_date",
        F.col("factor").alias("factor_i"),
        F.col("factor").alias("factor_j"),
        F.when(F.col("factor") == K.COUNTRY, COUNTRY_VAR).otherwise(INDUSTRY_VAR).alias("cov"),
    )
    return cov.unionByName(diagonal)


def alpha(panel: DataFrame, calendar: DataFrame, max_rows: int | None) -> DataFrame:
    """(date, code, alpha): z-score of the month's reversal, on every odd month."""
    rows = with_day(panel, calendar).where(F.col("day") % 2 == 1)
    raw = rows.select("date", "code", (-(ratio(F.col("close"), F.col("pre_close")) - 1)).alias("alpha")).where(
        F.col("alpha").isNotNull()
    )
    return zscore(raw, "alpha", "alpha", max_rows=max_rows)
