"""Factor exposures, covariance and specific variance as long tables.

Exposures are (rebal_date, code, factor, x) with zeros left out; covariance is
(rebal_date, factor_i, factor_j, cov); specific variance (rebal_date, code,
spec_var).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidefolio.functions import fixed as K
from tidefolio.operators.calendar import asof_dates, between_dates
from tidefolio.operators.groups import quantiles, with_median
from tidefolio.operators.timeseries import one_row_per_key


def style_exposures(scores: DataFrame, start=None, end=None) -> DataFrame:
    """Summed z-score per (rebal_date, code, factor) of the estimation universe.

    ``scores``: (date, code, factor, zscore, univ_flag); names outside the
    universe and factors that are no style are left out.
    """
    kept = between_dates(scores, start, end).where(
        (F.col("univ_flag") == 1) & F.col("factor").isin(*K.STYLE_FACTORS)
    )
    return kept.groupBy(F.col("date").alias("rebal_date"), "code", "factor").agg(F.sum("zscore").alias("x"))


def industry_exposures(panel: DataFrame) -> DataFrame:
    """One unit exposure per name to its industry; unknown industries have none."""
    industry = F.col("industry_l1")
    return (
        one_row_per_key(panel.select("date", "code", "industry_l1"), prefer=F.col("industry_l1"))
        .where(industry.isNotNull() & ~industry.isin("", K.UNKNOWN_INDUSTRY))
        .select(F.col("date").alias("rebal_date"), "code", industry.alias("factor"), F.lit(1.0).alias("x"))
    )


def country_exposures(names: DataFrame) -> DataFrame:
    """Unit exposure of every name to the market."""
    return names.select("rebal_date", "code", F.lit(K.COUNTRY).alias("factor"), F.lit(1.0).alias("x"))


def exposure_panel(styles: DataFrame, panel: DataFrame) -> DataFrame:
    """Style, country and industry exposures of the names that have styles."""
    names = styles.select("rebal_date", "code").distinct()
    industries = industry_exposures(panel).join(names, ["rebal_date", "code"], "left_semi")
    return styles.unionByName(country_exposures(names)).unionByName(industries)


def wide_exposures(exposures: DataFrame, factors: Sequence[str]) -> DataFrame:
    """One column per factor, absent exposures as 0; for export only."""
    wide = exposures.groupBy("rebal_date", "code").pivot("factor", list(factors)).agg(F.sum("x"))
    return wide.fillna(0.0, list(factors))


def fill_specific(names: DataFrame, specific: DataFrame, max_rows: int | None = None) -> DataFrame:
    """(rebal_date, code, spec_var) for every name, missing as the date's median."""
    joined = names.select("rebal_date", "code").join(specific, ["rebal_date", "code"], "left")
    filled = with_median(joined, ["rebal_date"], "spec_var", "_mid", max_rows)
    return filled.select("rebal_date", "code", F.coalesce("spec_var", "_mid").alias("spec_var"))


def mirror_covariance(cov: DataFrame) -> DataFrame:
    """Both orientations of every stored pair, one row per ordered pair.

    If both were stored and differ, the one with factor_i <= factor_j holds.
    """
    stored = cov.select("rebal_date", "factor_i", "factor_j", "cov", (F.col("factor_i") > F.col("factor_j")).alias("_late"))
    swapped = stored.select(
        "rebal_date", F.col("factor_j").alias("factor_i"), F.col("factor_i").alias("factor_j"), "cov", "_late"
    )
    both = stored.unionByName(swapped)
    return one_row_per_key(both, ["rebal_date", "factor_i", "factor_j"], F.struct("_late", "cov")).drop("_late")


def symmetric_covariance(cov: DataFrame) -> DataFrame:
    """Mean of a covariance and its transpose; a single orientation counts alone."""
    swapped = cov.select("rebal_date", F.col("factor_j").alias("factor_i"), F.col("factor_i").alias("factor_j"), "cov")
    return (
        cov.select("rebal_date", "factor_i", "factor_j", "cov")
        .unionByName(swapped)
        .groupBy("rebal_date", "factor_i", "factor_j")
        .agg(F.avg("cov").alias("cov"))
    )


def is_style(factor: str = "factor"):
    return F.col(factor).isin(*K.STYLE_FACTORS)


def risk_dates(targets: DataFrame, cov: DataFrame) -> DataFrame:
    """(date, rebal_date) of the latest risk date; targets before the first have none."""
    known = cov.select(F.col("rebal_date").alias("date")).distinct()
    return asof_dates(targets, known, "rebal_date").where(F.col("rebal_date").isNotNull())


def exposures_asof(universe: DataFrame, dates: DataFrame, exposures: DataFrame) -> DataFrame:
    """(date, code, factor, x) of the universe at each date's risk date.

    A name without an exposure has no row, which stands for 0.
    """
    return (
        exposures.join(F.broadcast(dates), "rebal_date")
        .join(universe.select("date", "code"), ["date", "code"])
        .select("date", "code", "factor", "x")
    )


def specific_asof(universe: DataFrame, dates: DataFrame, specific: DataFrame, max_rows: int | None = None) -> DataFrame:
    """(date, code, spec_var) of the universe, missing as the risk date's median.

    The median is over all names of the risk date, not over the universe.
    """
    mids = quantiles(specific, ["rebal_date"], "spec_var", {"_mid": 0.5}, max_rows)
    at = universe.select("date", "code").join(F.broadcast(dates), "date")
    return (
        at.join(specific, ["rebal_date", "code"], "left")
        .join(mids, "rebal_date", "left")
        .select("date", "code", F.coalesce("spec_var", "_mid").alias("spec_var"))
    )


def factor_exposure(weights: DataFrame, exposures: DataFrame, weight: str = "weight", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, factor, exposure): weighted sum of exposures."""
    return (
        weights.where(F.col(weight) != 0)
        .join(exposures, ["date", "code"])
        .groupBy(*keys, "date", "factor")
        .agg(F.sum(F.col("x") * F.col(weight)).alias("exposure"))
    )


def risk_decomposition(
    weights: DataFrame,
    exposures: DataFrame,
    specific: DataFrame,
    cov: DataFrame,
    dates: DataFrame,
    weight: str = "weight",
    keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, date, factor_risk, specific_risk, total_risk), all variances.

    With active weights the total is the squared tracking error. The holdings
    are first summed to a few dozen factor exposures per date; only those
    meet the covariance.
    """
    at = [*keys, "date"]
    # a map of the few dozen factors of a date, so that holdings meet exposures once
    sums = factor_exposure(weights, exposures, weight, keys).groupBy(*at).agg(
        F.map_from_entries(F.collect_list(F.struct("factor", "exposure"))).alias("_e")
    )
    e = F.col("_e")
    pairs = (
        sums.join(F.broadcast(dates), "date")
        .join(cov, "rebal_date")
        .groupBy(*at)
        .agg(F.sum(e[F.col("factor_i")] * F.col("cov") * e[F.col("factor_j")]).alias("factor_risk"))
    )
    own = (
        weights.where(F.col(weight) != 0)
        .join(specific, ["date", "code"])
        .groupBy(*at)
        .agg(F.sum(F.col("spec_var") * F.col(weight) * F.col(weight)).alias("specific_risk"))
    )
    zero = F.lit(0.0)
    return own.join(pairs, at, "full").select(
        *at,
        F.coalesce("factor_risk", zero).alias("factor_risk"),
        F.coalesce("specific_risk", zero).alias("specific_risk"),
        (F.coalesce("factor_risk", zero) + F.coalesce("specific_risk", zero)).alias("total_risk"),
    )
