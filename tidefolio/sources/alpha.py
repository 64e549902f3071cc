"""Alpha scores from Parquet, long or wide; the result is always long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidefolio.functions.cols import flexible_date, null_if_nan
from tidefolio.operators.calendar import asof_join

# A wide table saved by pandas keeps an unnamed index under this name.
INDEX_COLUMN = "__index_level_0__"


def alpha_from(table: DataFrame) -> DataFrame:
    """(date, code, alpha), missing scores left out, from either layout."""
    if {"date", "code", "alpha"}.issubset(table.columns):
        long = table.select("date", "code", "alpha")
    else:
        day = "date" if "date" in table.columns else INDEX_COLUMN
        if day not in table.columns:
            raise KeyError("a wide alpha table needs a date column")
        codes = [c for c in table.columns if c != day]
        wide = table.select(F.col(day).alias("date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in codes])
        long = wide.unpivot("date", [F.col(f"`{c}`") for c in codes], "code", "alpha")
    return long.select(
        flexible_date(F.col("date")).alias("date"),
        "code",
        null_if_nan(F.col("alpha").cast("double")).alias("alpha"),
    ).where(F.col("alpha").isNotNull())


def load_alpha(spark: SparkSession, path: str) -> DataFrame:
    return alpha_from(spark.read.parquet(path))


def alpha_asof(universe: DataFrame, targets: DataFrame, alpha: DataFrame) -> DataFrame:
    """Add ``alpha`` of the latest alpha date not after the row's date, else 0."""
    scores = alpha.withColumnRenamed("date", "alpha_date")
    out = asof_join(universe, targets, scores, "alpha_date")
    return out.withColumn("alpha", F.coalesce("alpha", F.lit(0.0)))
