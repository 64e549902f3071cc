"""Trading calendar, rebalance dates, as-of dates and holding periods.

A calendar holds distinct DATE values, of which the type has under four
million, so one window over a calendar is bounded and a calendar may always be
broadcast. Every as-of and next-day rule is resolved on calendars first; fact
tables then meet them in equi joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F


def between_dates(df: DataFrame, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Rows of a closed date range; either side may be open."""
    if start is not None:
        df = df.where(F.col("date") >= F.to_date(F.lit(str(start))))
    if end is not None:
        df = df.where(F.col("date") <= F.to_date(F.lit(str(end))))
    return df


def trading_calendar(df: DataFrame) -> DataFrame:
    """(date, day, next_date, days): every date once, numbered from 0 without gaps."""
    w = Window.orderBy("date")
    return (
        df.select("date")
        .where(F.col("date").isNotNull())
        .distinct()
        .select(
            "date",
            (F.row_number().over(w) - 1).alias("day"),
            F.lead("date").over(w).alias("next_date"),
            F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("days"),
        )
    )


def with_day(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add the calendar position of each row's date."""
    return df.join(F.broadcast(calendar.select("date", "day")), "date")


def rebalance_dates(
    calendar: DataFrame, every: int, start: date | str | None = None, end: date | str | None = None
) -> DataFrame:
    """Every k-th trading date of the range, from its first."""
    days = between_dates(calendar.select("date"), start, end)
    return (
        days.withColumn("_rn", F.row_number().over(Window.orderBy("date")))
        .where((F.col("_rn") - 1) % every == 0)
        .select("date")
    )


def asof_dates(targets: DataFrame, available: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """For each target date the latest available date not after it, else NULL.

    Both tables hold dates only (per key). They are merged into one ordered
    list, and each target takes the last available date seen so far.
    """
    marked = targets.select(*keys, "date", F.lit(1).alias("_want"), F.lit(None).cast("date").alias(name)).unionByName(
        available.select(*keys, "date", F.lit(0).alias("_want"), F.col("date").alias(name)).distinct()
    )
    w = (
        Window.partitionBy(*keys)
        .orderBy("date", "_want")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.withColumn(name, F.last(name, ignorenulls=True).over(w))
        .where(F.col("_want") == 1)
        .drop("_want")
    )


def asof_join(
    wanted: DataFrame, targets: DataFrame, source: DataFrame, source_date: str, keys: Sequence[str] = ("code",)
) -> DataFrame:
    """Left join to the source's rows of the latest source date not after the row's date.

    ``targets`` holds the distinct dates of ``wanted``. The whole source date
    is taken, not each code's own last value. Adds the chosen date under
    ``source_date``.
    """
    dates = asof_dates(targets, source.select(F.col(source_date).alias("date")), source_date)
    return wanted.join(F.broadcast(dates), "date", "left").join(source, [source_date, *keys], "left")


def execution_dates(calendar: DataFrame, signals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, exec_date, next_exec_date) for distinct signal dates.

    A signal executes on the next trading day; one on the last day never does.
    """
    w = Window.partitionBy(*keys).orderBy("exec_date")
    return (
        signals.select(*keys, "date")
        .distinct()
        .join(F.broadcast(calendar.select("date", F.col("next_date").alias("exec_date"))), "date")
        .where(F.col("exec_date").isNotNull())
        .withColumn("next_exec_date", F.lead("exec_date").over(w))
        .select(*keys, "date", "exec_date", "next_exec_date")
    )


def holding_days(calendar: DataFrame, executions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, signal_date, exec_date, date): every trading day a signal is in force.

    From its execution until the day before the next execution, found by
    position: each execution is fanned out over the days it lasts.
    """
    days = F.broadcast(calendar.select(F.col("date").alias("exec_date"), "day", "days"))
    w = Window.partitionBy(*keys).orderBy("exec_date")
    spans = (
        executions.select(*keys, F.col("date").alias("signal_date"), "exec_date")
        .join(days, "exec_date")
        .withColumn("_until", F.coalesce(F.lead("day").over(w), "days"))
    )
    return (
        spans.withColumn("day", F.explode(F.sequence("day", F.col("_until") - 1)))
        .join(F.broadcast(calendar.select("date", "day")), "day")
        .select(*keys, "signal_date", "exec_date", "date")
    )


def at_offset(value: str | Column, offset: int, key: Sequence[str] = ("code",)) -> Column:
    """The key's value ``offset`` calendar positions away; NULL if it has no row there."""
    w = Window.partitionBy(*key).orderBy("day").rangeBetween(offset, offset)
    return F.max(value).over(w)
