"""Stored risk model: exposure and covariance panels of two variants.

Both tables are partitioned by variant: S for short, L for long horizons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidefolio.functions.cols import null_if_nan
from tidefolio.operators.risk import symmetric_covariance

KEYS = {"rebal_date", "code", "spec_var", "variant"}


def write_risk_panels(exposures: DataFrame, specific: DataFrame, cov: DataFrame, path: str) -> None:
    """Long tables with a ``variant`` column."""
    for name, df in (("exposure", exposures), ("specific", specific), ("covariance", cov)):
        df.write.mode("overwrite").partitionBy("variant").parquet(f"{path}/{name}")


def load_risk_panels(spark: SparkSession, path: str, variant: str = "S") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exposures, specific, covariance) of one variant; covariance is symmetric."""
    exposures, specific, cov = (
        spark.read.parquet(f"{path}/{n}").where(F.col("variant") == variant).drop("variant")
        for n in ("exposure", "specific", "covariance")
    )
    return exposures, specific, symmetric_covariance(cov)


def long_exposures(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exposures, specific) from a table with one column per factor."""
    factors = [c for c in wide.columns if c not in KEYS]
    dated = wide.withColumn("rebal_date", F.col("rebal_date").cast("date"))
    long = dated.unpivot(["rebal_date", "code"], [F.col(f"`{f}`") for f in factors], "factor", "x")
    x = null_if_nan(F.col("x").cast("double"))
    return (
        long.withColumn("x", x).where(F.col("x").isNotNull() & (F.col("x") != 0)),
        dated.select("rebal_date", "code", null_if_nan(F.col("spec_var").cast("double")).alias("spec_var")),
    )


def long_covariance(wide: DataFrame) -> DataFrame:
    """Symmetric (rebal_date, factor_i, factor_j, cov) from a K x K table per date."""
    factors = [c for c in wide.columns if c not in ("rebal_date", "factor")]
    long = wide.withColumn("rebal_date", F.col("rebal_date").cast("date")).unpivot(
        ["rebal_date", F.col("factor")], [F.col(f"`{f}`") for f in factors], "factor_j", "cov"
    )
    known = long.withColumnRenamed("factor", "factor_i").where(F.col("cov").isNotNull())
    return symmetric_covariance(known)
