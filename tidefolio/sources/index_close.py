"""Index closes from a wide CSV: a YYYYMMDD date and one column per index."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import null_if_nan
from tidefolio.operators.calendar import between_dates
from tidefolio.operators.timeseries import series_returns


def index_column(index: str) -> str:
    """Column of an index key; a column name stands for itself."""
    return K.INDEX_CLOSE_COLUMNS.get(index, index)


def read_closes(spark: SparkSession, path: str) -> DataFrame:
    """(index_key, date, close) of every index column, missing closes left out."""
    wide = spark.read.csv(path, header=True)
    names = [c for c in wide.columns if c != "date"]
    long = wide.select(
        F.try_to_date("date", "yyyyMMdd").alias("date"),
        *[null_if_nan(F.expr(f"try_cast(`{c}` as double)")).alias(c) for c in names],
    ).unpivot("date", names, "index_key", "close")
    return long.where(F.col("close").isNotNull()).select("index_key", "date", "close")


def available_indices(spark: SparkSession, path: str) -> DataFrame:
    """(index_key, closes) of the columns with at least one close."""
    return read_closes(spark, path).groupBy("index_key").agg(F.count("close").alias("closes"))


def _one_index(spark: SparkSession, index: str, path: str) -> DataFrame:
    column = index_column(index)
    header = spark.read.csv(path, header=True).columns
    if column not in header or column == "date":
        raise KeyError(f"no index column {column!r} in {path}; it has {[c for c in header if c != 'date']}")
    return read_closes(spark, path).where(F.col("index_key") == column)


def _not_empty(df: DataFrame, index: str, start, end) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"index {index!r} has no closes in {start}..{end}")
    return df


def load_index_close(
    spark: SparkSession, index: str, path: str, start: date | str | None = None, end: date | str | None = None
) -> DataFrame:
    """Closes of one index in a closed date range; none is an error."""
    return _not_empty(between_dates(_one_index(spark, index, path), start, end), index, start, end)


def load_index_returns(
    spark: SparkSession, index: str, path: str, start: date | str | None = None, end: date | str | None = None
) -> DataFrame:
    """Returns of one index; the first day of the range uses the close before it."""
    closes = _not_empty(between_dates(_one_index(spark, index, path), None, end), index, None, end)
    return between_dates(series_returns(closes), start, None)
