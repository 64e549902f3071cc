"""Per-code series over the panel calendar.

The windows here are partitioned by code; (date, code) is the panel's key, so
no partition is longer than the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import ratio
from tidefolio.operators.calendar import at_offset, with_day
from tidefolio.operators.groups import with_median

FOLD = 64


def one_row_per_key(df: DataFrame, keys: Sequence[str] = ("date", "code"), prefer: Column | None = None) -> DataFrame:
    """One row per key: the one with the smallest ``prefer``, by default the smallest row.

    Which row stays does not depend on how the data is partitioned.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    row = F.struct(*others)
    kept = F.min(row) if prefer is None else F.min_by(row, prefer)
    return (
        df.groupBy(*keys)
        .agg(kept.alias("_row"))
        .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
    )


def average_daily_value(panel: DataFrame, window: int = K.ADV_WINDOW) -> DataFrame:
    """Add ``adv`` (yuan): mean of the last 20 amounts known by the date.

    Suspended days and missing amounts are skipped, not counted; a code
    without any gets 1e5.
    """
    counted = F.when(
        ~F.coalesce(F.col("trade_status") == K.HALTED, F.lit(False)), F.col("amount")
    )
    by_code = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a skipped day shares the number of the last counted one, so the range
    # of the last 20 numbers holds exactly the last 20 counted amounts
    last = Window.partitionBy("code").orderBy("_nth").rangeBetween(1 - window, Window.currentRow)
    return (
        panel.withColumn("_amount", counted)
        .withColumn("_nth", F.count("_amount").over(by_code))
        .withColumn("adv", F.coalesce(F.avg("_amount").over(last) * 1000, F.lit(K.ADV_FILL)))
        .drop("_amount", "_nth")
    )


def forward_returns(panel: DataFrame, calendar: DataFrame, days: int, price: str = "adj_close") -> DataFrame:
    """Add ``fwd_ret``: price ``days`` panel dates later over today's, minus 1."""
    rows = with_day(panel, calendar)
    return rows.withColumn("fwd_ret", ratio(at_offset(price, days), F.col(price)) - 1).drop("day")


def daily_returns(panel: DataFrame, calendar: DataFrame, price: str = "adj_close", name: str = "ret") -> DataFrame:
    """Add the change since the previous panel date, without filling gaps."""
    rows = with_day(panel, calendar)
    return rows.withColumn(name, ratio(F.col(price), at_offset(price, -1)) - 1).drop("day")


def series_returns(closes: DataFrame, key: str = "index_key") -> DataFrame:
    """Returns of index series over their own rows; the first has none."""
    w = Window.partitionBy(key).orderBy("date")
    return (
        closes.where(F.col("close").isNotNull())
        .withColumn("ret", ratio(F.col("close"), F.lag("close").over(w)) - 1)
        .where(F.col("ret").isNotNull())
    )


def valid_dates(rows: DataFrame, min_names: int = 50, value: str = "fwd_ret") -> DataFrame:
    """Dates with more than ``min_names`` known values (strictly more)."""
    return (
        rows.groupBy("date")
        .agg(F.count(value).alias("names"))
        .where(F.col("names") > min_names)
    )


def impact_costs(
    panel: DataFrame,
    calendar: DataFrame,
    targets: DataFrame,
    universe: DataFrame | None = None,
    window: int = K.COST_WINDOW,
    max_rows: int | None = None,
) -> DataFrame:
    """(date, code, cost): volatility over root of traded value, median 1.

    For each target date over the last 20 panel dates: yearly deviation of the
    daily returns inside the window, mean amount with suspended zeros, at
    least 1. Unknown costs become 1, all are kept in [0.1, 10], and all are 1
    while the window has fewer than 5 dates. ``universe`` (date, code) limits
    the names that are priced and enter the median.
    """
    by_code = Window.partitionBy("code").orderBy("day")
    # the first return inside the window needs a price inside it too
    vol = F.stddev_samp("_ret").over(by_code.rangeBetween(2 - window, 0)) * F.sqrt(F.lit(float(K.TRADING_DAYS)))
    value = F.avg("amount").over(by_code.rangeBetween(1 - window, 0))
    raw = (
        with_day(panel.select("date", "code", "adj_close", "amount"), calendar)
        .withColumn("_ret", ratio(F.col("adj_close"), at_offset("adj_close", -1)) - 1)
        .withColumn("_vol", vol)
        .withColumn("_value", value)
        .withColumn("raw", F.when(F.col("_value").isNotNull(), F.col("_vol") / F.sqrt(F.greatest("_value", F.lit(1.0)))))
        .select("date", "code", "day", "raw")
        .join(F.broadcast(targets.select("date")), "date", "left_semi")
    )
    if universe is not None:
        raw = raw.join(universe.select("date", "code"), ["date", "code"], "left_semi")
    scaled = with_median(raw, ["date"], "raw", "_mid", max_rows)
    low, high = K.COST_RANGE
    cost = F.when(F.col("_mid") > 1e-12, F.col("raw") / F.col("_mid")).otherwise(F.col("raw"))
    cost = F.least(F.greatest(F.coalesce(cost, F.lit(1.0)), F.lit(low)), F.lit(high))
    short = F.least(F.col("day") + 1, F.lit(window)) < K.COST_MIN_DATES
    return scaled.select("date", "code", F.when(short, 1.0).otherwise(cost).alias("cost"))


def smooth(signal: DataFrame, keys: Sequence[str] = ("code",), decay: str = "decay", value: str = "s") -> DataFrame:
    """Add ``f``: f_t = d f_(t-1) + sqrt(1 - d^2) s_t along each unbroken run of days.

    A key that misses a day starts again from s. Needs the columns ``day`` and
    ``decay``; a decay of 0 keeps s. A run is folded as one array, which is no
    longer than the calendar, in blocks of 64 days: a growing array is copied
    within its block only.
    """
    by_key = Window.partitionBy(*keys, decay).orderBy("day")
    run = F.col("day") - F.row_number().over(by_key)
    others = [c for c in signal.columns if c not in (*keys, decay)]
    rows = F.sort_array(F.collect_list(F.struct("day", *[c for c in others if c != "day"])))
    d = F.col(decay)

    def day(done: Column, row: Column) -> Column:
        f = F.when(done["n"] == 0, row[value]).otherwise(d * done["f"] + F.sqrt(1 - d * d) * row[value])
        return F.struct((done["n"] + 1).alias("n"), f.alias("f"), F.concat(done["out"], F.array(f)).alias("out"))

    def block(done: Column, i: Column) -> Column:
        start = F.struct(done["n"].alias("n"), done["f"].alias("f"), F.expr("cast(array() as array<double>)").alias("out"))
        end = F.aggregate(F.slice("_rows", i * FOLD + 1, FOLD), start, day)
        return F.struct(end["n"].alias("n"), end["f"].alias("f"), F.concat(done["outs"], F.array(end["out"])).alias("outs"))

    empty = F.expr("named_struct('n', 0, 'f', cast(null as double), 'outs', cast(array() as array<array<double>>))")
    blocks = F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / FOLD).cast("int"))
    folded = (
        signal.withColumn("_run", run)
        .groupBy(*keys, decay, "_run")
        .agg(rows.alias("_rows"))
        .withColumn("_f", F.flatten(F.aggregate(blocks, empty, block)["outs"]))
    )
    return (
        folded.select(*keys, decay, F.explode(F.arrays_zip("_rows", "_f")).alias("_z"))
        .select(*keys, decay, *[F.col("_z._rows")[c].alias(c) for c in others], F.col("_z._f").alias("f"))
    )
