"""Result tables: weights, signals, summaries and report data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_weights(weights: DataFrame, path: str) -> None:
    """(scenario_id, date, code, weight), one folder per scenario."""
    weights.write.mode("overwrite").partitionBy("scenario_id").parquet(path)


def write_signals(signals: DataFrame, path: str) -> None:
    """(param_id, date, code, alpha), one folder per grid point."""
    signals.write.mode("overwrite").partitionBy("param_id").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One CSV file with a header; a summary has one row per grid point."""
    summary.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """The tables of a report, one Parquet folder per name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
