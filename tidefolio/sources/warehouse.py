"""Read-only warehouse queries through Spark's JDBC source."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_query(
    spark: SparkSession,
    sql: str,
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 64,
    timeout: int = 600,
    fetch_size: int = 50_000,
) -> DataFrame:
    """Rows of a SELECT, read in parallel ranges of ``partition_column``.

    Address and credentials come from WAREHOUSE_URL, WAREHOUSE_USER and
    WAREHOUSE_PASSWORD; the driver jar must be on the class path.
    """
    if not sql.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only SELECT statements are read")
    reader = (
        spark.read.format("jdbc")
        .option("url", os.environ["WAREHOUSE_URL"])
        .option("user", os.environ.get("WAREHOUSE_USER", ""))
        .option("password", os.environ.get("WAREHOUSE_PASSWORD", ""))
        .option("dbtable", f"({sql.rstrip().rstrip(';')}) q")
        .option("queryTimeout", str(timeout))
        .option("fetchsize", str(fetch_size))
    )
    if partition_column:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(lower))
            .option("upperBound", str(upper))
            .option("numPartitions", str(partitions))
        )
    return reader.load()


def ping(spark: SparkSession) -> bool:
    """Whether the warehouse answers."""
    return read_query(spark, "SELECT 1 AS one").first()[0] == 1
