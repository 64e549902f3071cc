"""Index weights from tiered free float, and the equal-weight benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidefolio.functions.cols import is_member, positive, ratio, tier_factor
from tidefolio.operators.calendar import asof_dates, asof_join, trading_calendar
from tidefolio.operators.crosssection import share_of_total


def adjusted_values(panel: DataFrame, index: str) -> DataFrame:
    """(date, code, adj_mv) of the members: market value times tiered free float."""
    return panel.where(is_member(index)).select(
        "date",
        "code",
        (positive(F.col("total_mv")) * tier_factor(F.col("free_mv"), F.col("total_mv"))).alias("adj_mv"),
    )


def benchmark_weights(
    panel: DataFrame,
    index: str,
    carry_leavers: bool = True,
    calendar: DataFrame | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """(date, code, bm_weight) on every date that has members.

    A missing value is carried forward from the code's last known one. With
    ``carry_leavers`` a code that leaves the index keeps its last value and
    stays in the sum; without, only the members of the date count.
    ``calendar`` may pass the dates that have members when they are known.
    """
    values = adjusted_values(panel, index)
    if carry_leavers:
        days = trading_calendar(values) if calendar is None else calendar
        known = values.where(F.col("adj_mv").isNotNull()).join(
            F.broadcast(days.select("date", "day", "days")), "date"
        )
        by_code = Window.partitionBy("code").orderBy("day")
        # each known value lasts until the code's next one, or to the end
        filled = (
            known.withColumn("_until", F.coalesce(F.lead("day").over(by_code), "days"))
            .select("code", "adj_mv", F.explode(F.sequence("day", F.col("_until") - 1)).alias("day"))
            .join(F.broadcast(days.select("day", "date")), "day")
        )
    else:
        so_far = (
            Window.partitionBy("code").orderBy("date")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        filled = values.withColumn("adj_mv", F.last("adj_mv", ignorenulls=True).over(so_far)).where(
            F.col("adj_mv").isNotNull()
        )
    shares = share_of_total(filled, "adj_mv", "bm_weight", max_rows=max_rows)
    return shares.select("date", "code", "bm_weight")


def benchmark_weights_at(
    panel: DataFrame, index: str, targets: DataFrame, calendar: DataFrame | None = None, max_rows: int | None = None
) -> DataFrame:
    """(date, code, bm_weight) with leavers carried, only on the dates that ``targets`` ask for.

    A target asks for the last date with members not after it. A known value
    counts from its day to the code's next one. Days are numbered by how many
    asked dates lie before them, so a span between two numbers holds just its
    asked dates; a span without one is dropped, and no other day is made.
    """
    values = adjusted_values(panel, index)
    days = (trading_calendar(values) if calendar is None else calendar).select("date")
    asked = asof_dates(targets.select("date").distinct(), days, "_asked").select(F.col("_asked").alias("date")).distinct()
    over_days = Window.orderBy("date")
    numbered = days.join(F.broadcast(asked.withColumn("_ask", F.lit(1))), "date", "left").select(
        "date",
        "_ask",
        F.coalesce(F.sum("_ask").over(over_days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"),
        F.coalesce(
            F.sum("_ask").over(over_days.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0)
        ).alias("_all"),
    )
    spans = (
        values.where(F.col("adj_mv").isNotNull())
        .join(F.broadcast(numbered.select("date", "_from", "_all")), "date")
        .withColumn("_until", F.coalesce(F.lead("_from").over(Window.partitionBy("code").orderBy("date")), "_all"))
        .where(F.col("_from") < F.col("_until"))
    )
    filled = spans.select("code", "adj_mv", F.explode(F.sequence("_from", F.col("_until") - 1)).alias("_from")).join(
        F.broadcast(numbered.where(F.col("_ask") == 1).select("_from", "date")), "_from"
    )
    shares = share_of_total(filled, "adj_mv", "bm_weight", max_rows=max_rows)
    return shares.select("date", "code", "bm_weight")


def benchmark_asof(
    universe: DataFrame, targets: DataFrame, weights: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Add ``bm_weight`` as of each row's date, 0 where absent, scaled to sum 1.

    Rows of dates before the first weights are left out.
    """
    held = weights.where(F.col("bm_weight") > 0).withColumnRenamed("date", "bm_date")
    found = asof_join(universe, targets, held, "bm_date").where(F.col("bm_date").isNotNull())
    filled = found.withColumn("bm_weight", F.coalesce("bm_weight", F.lit(0.0)))
    return share_of_total(filled, "bm_weight", "bm_weight", tiny=1e-8, max_rows=max_rows)


def weighted_return(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(date, bm_ret): sum of weight times the same day's return."""
    return (
        weights.join(returns.where(F.col("ret").isNotNull()), ["date", "code"])
        .groupBy("date")
        .agg(F.sum(F.col("bm_weight") * F.col("ret")).alias("bm_ret"))
    )


def equal_weight_return(returns: DataFrame) -> DataFrame:
    """(date, bm_ret): mean over all codes ever in the panel, missing returns as 0."""
    codes = returns.agg(F.countDistinct("code")).scalar()
    sums = returns.groupBy("date").agg(F.coalesce(F.sum("ret"), F.lit(0.0)).alias("_sum"))
    return sums.select("date", ratio(F.col("_sum"), codes).alias("bm_ret"))


def on_calendar(returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """Benchmark returns on every trading date, 0 where missing."""
    return calendar.select("date").join(returns, "date", "left").withColumn(
        "bm_ret", F.coalesce("bm_ret", F.lit(0.0))
    )
