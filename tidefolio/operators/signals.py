"""Signal research: calibration signals, rank IC, quantile spreads, persistence.

Signals are long: (keys, date, code, f), with keys such as the grid point and
seed, so a whole grid is measured by one set of jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import hash_normal, ratio
from tidefolio.operators.calendar import at_offset, with_day
from tidefolio.operators.crosssection import top_and_bottom, zscore
from tidefolio.operators.groups import average_ranks, repeat_for, with_aggregates
from tidefolio.operators.timeseries import forward_returns, smooth, valid_dates


def standard_forward_returns(
    panel: DataFrame,
    calendar: DataFrame,
    fwd_days: int = 5,
    min_names: int = 50,
    price: str = "adj_close",
    max_rows: int | None = None,
) -> DataFrame:
    """(date, code, fwd_ret, z) on dates with more than ``min_names`` known returns."""
    rows = (
        forward_returns(panel.select("date", "code", price), calendar, fwd_days, price)
        .where(F.col("fwd_ret").isNotNull())
        .select("date", "code", "fwd_ret")
    )
    counted = with_aggregates(rows, ["date"], {"_names": F.count("fwd_ret")}, max_rows)
    kept = counted.where(F.col("_names") > min_names).drop("_names")
    return zscore(kept, "fwd_ret", "z", min_std=1e-9, max_rows=max_rows)


def evaluation_dates(
    panel: DataFrame, calendar: DataFrame, fwd_days: int = 5, every: int = 5, min_names: int = 50, price: str = "adj_close"
) -> DataFrame:
    """Every k-th date that has more than ``min_names`` known forward returns."""
    rows = forward_returns(panel.select("date", "code", price), calendar, fwd_days, price)
    numbered = valid_dates(rows, min_names).withColumn("_rn", F.row_number().over(Window.orderBy("date")))
    return numbered.where((F.col("_rn") - 1) % every == 0).select("date")


def with_points(df: DataFrame, points: Sequence[tuple[float, float, float]] | DataFrame) -> DataFrame:
    """Repeat each row for every grid point (ic, ic_std, decay), given as tuples or as a table in_ic, in_ic_std, decay."""
    if isinstance(points, DataFrame):
        return repeat_for(df, points.select(*[F.col(c).cast("double").alias(c) for c in ("in_ic", "in_ic_std", "decay")]))
    cells = [
        F.struct(F.lit(float(a)).alias("in_ic"), F.lit(float(b)).alias("in_ic_std"), F.lit(float(d)).alias("decay"))
        for a, b, d in points
    ]
    return df.withColumn("_p", F.explode(F.array(*cells))).select("*", "_p.*").drop("_p")


def grid_points(ics=K.GRID_IC, icirs=K.GRID_ICIR, decay=0.8, decays=K.GRID_DECAY, ic=0.08, icir=0.8):
    """(sweep, ic, ic_std, decay): IC x ICIR at one decay, then decays at one point."""
    first = [("ic_icir", i, i / r, decay) for i in ics for r in icirs]
    return first + [("decay", ic, ic / icir, d) for d in decays]


def distinct_points(points: Sequence[tuple[str, float, float, float]]) -> list[tuple[str, float, float, float]]:
    """Grid points that differ after rounding to six places, first ones kept."""
    seen: dict[tuple, tuple] = {}
    for p in points:
        seen.setdefault(tuple(round(x, 6) for x in p[1:]), p)
    return list(seen.values())


def calibration_signals(
    forward: DataFrame,
    calendar: DataFrame,
    points: Sequence[tuple[float, float, float]] | DataFrame,
    seeds: Sequence[int] = K.GRID_SEEDS,
    max_rows: int | None = None,
) -> DataFrame:
    """(in_ic, in_ic_std, decay, seed, date, code, f): signals of a set strength.

    Each date's signal is rho z + sqrt(1 - rho^2) noise with rho drawn around
    ic and kept in +-0.95. It looks ahead by design and serves calibration
    only. Draws are hashes of (seed, date[, code]), so they do not depend on
    the grid point or on how rows are partitioned.
    """
    seed = F.col("seed")
    drawn = forward.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds]))).withColumns(
        {"_zr": hash_normal(seed, F.col("date")), "_eps": hash_normal(seed, F.col("date"), F.col("code"))}
    )
    rho = F.least(F.greatest(F.col("in_ic") + F.col("in_ic_std") * F.col("_zr"), F.lit(-0.95)), F.lit(0.95))
    mixed = with_points(drawn, points).withColumn("_rho", rho)
    raw = mixed.withColumn("s", F.col("_rho") * F.col("z") + F.sqrt(1 - F.col("_rho") ** 2) * F.col("_eps"))
    section = ["in_ic", "in_ic_std", "decay", "seed", "date"]
    scaled = zscore(raw, "s", "s", section, pad=1e-10, max_rows=max_rows)
    signal = with_day(scaled, calendar).select(*section, "code", "day", "s")
    smoothed = smooth(signal, ["in_ic", "in_ic_std", "seed", "code"])
    out = zscore(smoothed, "f", "f", section, pad=1e-10, max_rows=max_rows)
    return out.select(*section, "code", "f")


def measured_rows(
    signal: DataFrame,
    forward: DataFrame,
    dates: DataFrame,
    keys: Sequence[str] = (),
    q: float = 0.2,
    min_names: int = 50,
    max_rows: int | None = None,
) -> DataFrame:
    """Signal and forward return side by side on the evaluated dates, with the quantile flags."""
    section = [*keys, "date"]
    joined = (
        signal.where(F.col("f").isNotNull())
        .join(F.broadcast(dates.select("date")), "date", "left_semi")
        .join(forward.where(F.col("fwd_ret").isNotNull()).select("date", "code", "fwd_ret"), ["date", "code"])
    )
    grouped = top_and_bottom(joined, "f", q, section, max_rows)
    return grouped.where(F.col("names") >= min_names)


def information_coefficients(rows: DataFrame, keys: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    """(keys, date, ic, long_short): rank correlation and quantile spread per date."""
    section = [*keys, "date"]
    ranked = average_ranks(rows, section, {"_rf": "f", "_rr": "fwd_ret"}, max_rows)
    ic = F.corr("_rf", "_rr")
    spread = F.avg(F.when(F.col("top"), F.col("fwd_ret"))) - F.avg(F.when(F.col("bottom"), F.col("fwd_ret")))
    return ranked.groupBy(*section).agg(ic.alias("ic"), spread.alias("long_short")).withColumn(
        "ic", F.when(~F.isnan("ic"), F.col("ic"))
    )


def persistence(rows: DataFrame, keys: Sequence[str] = (), min_common: int = 10, max_rows: int | None = None) -> DataFrame:
    """(keys, date, autocorr, turnover) against the previous evaluated date.

    autocorr ranks the codes both dates have and needs more than ``min_common``
    of them; turnover is the share of the top group that was not in it before.
    The first evaluated date has no row.
    """
    by_keys = Window.partitionBy(*keys).orderBy("date")
    places = rows.select(*keys, "date").distinct().withColumn("day", F.row_number().over(by_keys))
    # a code's rows on evaluated dates are a short series; its previous one is one place back
    code = (*keys, "code")
    paired = (
        rows.join(places, [*keys, "date"])
        .withColumns(
            {
                "_before": at_offset("f", -1, code),
                "_was_top": at_offset(F.col("top").cast("int"), -1, code),
            }
        )
        .where(F.col("day") > 1)
    )
    section = [*keys, "date"]
    kept = F.count_if(F.col("top") & (F.col("_was_top") == 1))
    moved = paired.groupBy(*section).agg((1 - kept / F.max("k")).alias("turnover"))
    common = average_ranks(
        paired.where(F.col("_before").isNotNull()).select(*section, "code", "f", "_before"),
        section, {"_rf": "f", "_rb": "_before"}, max_rows,
    )
    auto = (
        common.groupBy(*section)
        .agg(F.corr("_rf", "_rb").alias("autocorr"), F.count(F.lit(1)).alias("_common"))
        .select(*section, F.when((F.col("_common") > min_common) & ~F.isnan("autocorr"), F.col("autocorr")).alias("autocorr"))
    )
    return moved.join(auto, section, "left").select(*section, "autocorr", "turnover")


def signal_statistics(
    ics: DataFrame, moves: DataFrame, keys: Sequence[str] = (), fwd_days: int = 5
) -> DataFrame:
    """Per key: ic, ic_std, icir, ir_theory, ls_ir, ls_ann, autocorr, turnover."""
    per_year = float(K.TRADING_DAYS) / fwd_days
    root = F.sqrt(F.lit(per_year))

    def spread_ratio(value: str):
        return F.when(F.count(value) > 1, F.avg(value) / (F.stddev_samp(value) + 1e-12)).otherwise(0.0)

    ic_mean = F.coalesce(F.avg("ic"), F.lit(0.0))
    ic_std = F.when(F.count("ic") > 1, F.stddev_samp("ic")).otherwise(0.0)
    icir = ic_mean / (ic_std + 1e-12)
    strength = ics.groupBy(*keys).agg(
        ic_mean.alias("ic"),
        ic_std.alias("ic_std"),
        icir.alias("icir"),
        (icir * root).alias("ir_theory"),
        (spread_ratio("long_short") * root).alias("ls_ir"),
        (F.coalesce(F.avg("long_short"), F.lit(0.0)) * per_year).alias("ls_ann"),
    )
    steadiness = moves.groupBy(*keys).agg(F.avg("autocorr").alias("autocorr"), F.avg("turnover").alias("turnover"))
    if keys:
        return strength.join(steadiness, list(keys), "left")
    one = F.lit(1).alias("_one")
    return strength.select("*", one).join(steadiness.select("*", one), "_one", "left").drop("_one")


def transfer_coefficient(full_ir, ir_theory):
    """Share of the theoretical information ratio that a strategy keeps."""
    return ratio(full_ir, ir_theory)
