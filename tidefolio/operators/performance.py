"""Performance of daily return series.

A series is (keys, date, ret, bm_ret). Windows here are partitioned by key and
ordered by date, so none is longer than the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import ratio

KEYS = ("scenario_id",)
SIDES = ("portfolio", "benchmark")


def _upto(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def nav_returns(nav: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``ret``, the change of nav; 0 on the first day."""
    w = Window.partitionBy(*keys).orderBy("date")
    return nav.withColumn("ret", F.coalesce(ratio(F.col("nav"), F.lag("nav").over(w)) - 1, F.lit(0.0)))


def against_benchmark(nav: DataFrame, benchmark: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Daily table: nav, ret, bm_ret, bm_nav, excess_ret, excess_nav, both drawdowns.

    A day without a benchmark return counts as 0.
    """
    rows = nav_returns(nav, keys).join(benchmark, "date", "left").withColumn("bm_ret", F.coalesce("bm_ret", F.lit(0.0)))
    w = _upto(keys)
    return (
        rows.withColumn("bm_nav", F.product(1 + F.col("bm_ret")).over(w))
        .withColumn("excess_ret", F.col("ret") - F.col("bm_ret"))
        .withColumn("excess_nav", ratio(F.col("nav"), F.col("bm_nav")))
        .withColumn("drawdown", F.col("nav") / F.max("nav").over(w) - 1)
        .withColumn("excess_drawdown", F.col("excess_nav") / F.max("excess_nav").over(w) - 1)
    )


def _navs(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add net values that start with the group's first day, and their drawdowns."""
    w = _upto(keys)
    return (
        daily.withColumn("_nav", F.product(1 + F.col("ret")).over(w))
        .withColumn("_raw", ratio(F.col("_nav"), F.product(1 + F.col("bm_ret")).over(w)))
        .withColumn("_exc", F.coalesce(F.last("_raw", ignorenulls=True).over(w), F.lit(1.0)))
        .withColumn("_dd", F.col("_nav") / F.max("_nav").over(w) - 1)
        .withColumn("_edd", F.col("_exc") / F.max("_exc").over(w) - 1)
    )


def _root_days() -> Column:
    return F.sqrt(F.lit(float(K.TRADING_DAYS)))


def both_sides(daily: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The portfolio against its benchmark, and the benchmark against zero."""
    zero = F.lit(0.0)
    sides = F.array(
        F.struct(F.lit(SIDES[0]).alias("side"), F.col("ret"), F.col("bm_ret")),
        F.struct(F.lit(SIDES[1]).alias("side"), F.col("bm_ret").alias("ret"), zero.alias("bm_ret")),
    )
    return daily.select(*keys, "date", F.explode(sides).alias("_s")).select(*keys, "date", "_s.*")


def monthly_returns(daily: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, month, port_ret, bm_ret, excess_ret) for every calendar month.

    ``month`` is the month's last day; a month without days inside the range
    has return 0.
    """
    found = daily.groupBy(*keys, F.trunc("date", "MM").alias("_m")).agg(
        (F.product(1 + F.col("ret")) - 1).alias("port_ret"), (F.product(1 + F.col("bm_ret")) - 1).alias("bm_ret")
    )
    spine = (
        found.groupBy(*keys)
        .agg(F.min("_m").alias("_a"), F.max("_m").alias("_b"))
        .select(*keys, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias("_m"))
    )
    filled = spine.join(found, [*keys, "_m"], "left").fillna(0.0, ["port_ret", "bm_ret"])
    return filled.select(
        *keys, F.last_day("_m").alias("month"), "port_ret", "bm_ret", (F.col("port_ret") - F.col("bm_ret")).alias("excess_ret")
    )


def metrics(daily: DataFrame, keys: Sequence[str] = KEYS, risk_free: float = K.RISK_FREE) -> DataFrame:
    """One row of performance figures per key.

    Compound annual return, sample deviations, Sharpe over the risk-free rate,
    arithmetic annual excess, geometric excess drawdown, months won.
    """
    root = _root_days()
    rf = (1 + risk_free) ** (1 / K.TRADING_DAYS) - 1
    ret, exc = F.col("ret"), F.col("ret") - F.col("bm_ret")
    figures = (
        _navs(daily, keys)
        .groupBy(*keys)
        .agg(
            (F.pow(F.product(1 + ret), float(K.TRADING_DAYS) / F.count(F.lit(1))) - 1).alias("annual_return"),
            (F.stddev_samp(ret) * root).alias("annual_vol"),
            ((F.avg(ret) - rf) / (F.stddev_samp(ret) + 1e-12) * root).alias("sharpe"),
            F.min("_dd").alias("max_drawdown"),
            (F.avg(exc) * K.TRADING_DAYS).alias("annual_excess_return"),
            (F.stddev_samp(exc) * root).alias("tracking_error"),
            F.min("_edd").alias("excess_max_drawdown"),
        )
    )
    months = monthly_returns(daily, keys).groupBy(*keys).agg(
        F.avg((F.col("excess_ret") > 0).cast("double")).alias("win_rate_monthly"),
        F.avg("excess_ret").alias("avg_monthly_excess"),
    )
    return (
        figures.join(months, list(keys))
        .withColumn("calmar", F.col("annual_return") / (F.abs("max_drawdown") + 1e-12))
        .withColumn("info_ratio", F.col("annual_excess_return") / (F.col("tracking_error") + 1e-12))
        .withColumn("excess_calmar", F.col("annual_excess_return") / (F.abs("excess_max_drawdown") + 1e-12))
        .select(*keys, *K.METRICS)
    )


def tall_metrics(daily: DataFrame, keys: Sequence[str] = KEYS, risk_free: float = K.RISK_FREE) -> DataFrame:
    """(keys, metric, portfolio, benchmark)."""
    sides = metrics(both_sides(daily, keys), [*keys, "side"], risk_free)
    long = sides.unpivot([*keys, "side"], list(K.METRICS), "metric", "value")
    return long.groupBy(*keys, "metric").pivot("side", list(SIDES)).agg(F.first("value"))


def yearly_breakdown(daily: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per year: returns, geometric excess, risk; net values restart each year.

    The Sharpe ratio here has no risk-free rate.
    """
    root = _root_days()
    at = [*keys, "year"]
    ret, exc = F.col("ret"), F.col("ret") - F.col("bm_ret")
    zero = F.lit(0.0)
    more = F.count(F.lit(1)) > 1

    def several(c: Column) -> Column:
        return F.when(more, c).otherwise(zero)

    figures = (
        _navs(daily.withColumn("year", F.year("date")), at)
        .groupBy(*at)
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            (F.product(1 + ret) - 1).alias("port_ret"),
            (F.product(1 + F.col("bm_ret")) - 1).alias("bm_ret"),
            several(F.stddev_samp(ret) * root).alias("vol"),
            F.min("_dd").alias("max_dd"),
            several(F.avg(ret) / (F.stddev_samp(ret) + 1e-12) * root).alias("sharpe"),
            (F.avg(exc) * K.TRADING_DAYS).alias("_exc"),
            several(F.stddev_samp(exc) * root).alias("excess_te"),
            F.min("_edd").alias("excess_dd"),
        )
    )
    annual = F.pow(1 + F.col("port_ret"), float(K.TRADING_DAYS) / F.col("n_days")) - 1
    base = 1 + F.col("bm_ret")
    return figures.select(
        *at, "n_days", "port_ret", "bm_ret",
        F.when(base > 1e-8, (1 + F.col("port_ret")) / base - 1).otherwise(zero).alias("excess_ret"),
        "vol", "max_dd", "sharpe",
        (annual / (F.abs("max_dd") + 1e-12)).alias("calmar"),
        (F.col("_exc") / (F.col("excess_te") + 1e-12)).alias("info_ratio"),
        "excess_te", "excess_dd",
    )


def yearly_table(daily: DataFrame, keys: Sequence[str] = KEYS, risk_free: float = K.RISK_FREE) -> DataFrame:
    """The yearly rows and a full-period row (year NULL) in yearly figures."""
    years = yearly_breakdown(daily, keys)
    own = metrics(daily, keys, risk_free)
    bench = metrics(both_sides(daily, keys).where(F.col("side") == SIDES[1]).drop("side"), keys, risk_free).select(
        *keys, F.col("annual_return").alias("bm_ret")
    )
    sizes = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"))
    full = own.join(bench, list(keys)).join(sizes, list(keys)).select(
        *keys, F.lit(None).cast("int").alias("year"), "n_days", F.col("annual_return").alias("port_ret"), "bm_ret",
        F.col("annual_excess_return").alias("excess_ret"), F.col("annual_vol").alias("vol"),
        F.col("max_drawdown").alias("max_dd"), "sharpe", "calmar", "info_ratio",
        F.col("tracking_error").alias("excess_te"), F.col("excess_max_drawdown").alias("excess_dd"),
    )
    return years.unionByName(full)


def monthly_grid(months: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Excess returns in percent, one row per year and one column m1..m12 per month."""
    rows = months.select(*keys, F.year("month").alias("year"), F.month("month").alias("_m"), (F.col("excess_ret") * 100).alias("_x"))
    wide = rows.groupBy(*keys, "year").pivot("_m", list(range(1, 13))).agg(F.first("_x"))
    return wide.withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})


def win_rates(months: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, year, month_of_year, win_rate, excess_pct): by year, by calendar month, overall.

    The columns that a row sums over are NULL; excess_pct is the summed excess.
    """
    rows = months.select(*keys, F.year("month").alias("year"), F.month("month").alias("month_of_year"), "excess_ret")
    year, month = F.col("year"), F.col("month_of_year")
    cols = [F.col(k) for k in keys]
    sets = rows.groupingSets([[*cols, year], [*cols, month], cols], *cols, year, month)
    return sets.agg(
        F.avg((F.col("excess_ret") > 0).cast("double")).alias("win_rate"),
        (F.sum("excess_ret") * 100).alias("excess_pct"),
    )
