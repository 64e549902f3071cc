"""Scaling and ranking within a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidefolio.functions.cols import ratio
from tidefolio.operators.groups import fits_one_task, join_groups, quantiles, row_numbers, with_aggregates
from tidefolio.session import cut_lineage

DATE = ("date",)


def share_of_total(
    df: DataFrame,
    value: str,
    name: str,
    group: Sequence[str] = DATE,
    tiny: float | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Add value over the group's sum.

    A zero sum gives NULL; with ``tiny`` the value stays as it is unless the
    sum exceeds it.
    """
    out = with_aggregates(df, group, {"_total": F.sum(value)}, max_rows)
    if tiny is None:
        share = ratio(F.col(value), F.col("_total"))
    else:
        share = F.when(F.col("_total") > tiny, F.col(value) / F.col("_total")).otherwise(F.col(value))
    return out.withColumn(name, share).drop("_total")


def zscore(
    df: DataFrame,
    value: str,
    name: str,
    group: Sequence[str] = DATE,
    ddof: int = 1,
    min_std: float | None = None,
    pad: float = 0.0,
    max_rows: int | None = None,
) -> DataFrame:
    """Add (value - mean) / (std + pad).

    With ``min_std``, groups whose deviation is not above it are left out.
    """
    std = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    out = with_aggregates(df, group, {"_mean": F.avg(value), "_std": std}, max_rows)
    if min_std is not None:
        out = out.where(F.col("_std") >= min_std)
    return out.withColumn(name, ratio(F.col(value) - F.col("_mean"), F.col("_std") + pad)).drop("_mean", "_std")


def winsorise(
    df: DataFrame, value: str, name: str, tail: float = 0.01, group: Sequence[str] = DATE, max_rows: int | None = None
) -> DataFrame:
    """Add the value clipped to the group's tail quantiles."""
    probs = {"_lo": tail, "_hi": 1 - tail}
    if fits_one_task(df, max_rows):
        both = F.percentile(value, F.array(*[F.lit(p) for p in probs.values()]))
        out = with_aggregates(df, group, {"_q": both}, max_rows).withColumns(
            {n: F.col("_q")[i] for i, n in enumerate(probs)}
        ).drop("_q")
    else:
        df = cut_lineage(df)
        out = join_groups(df, quantiles(df, group, value, probs, max_rows), group)
    clipped = F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), F.col("_hi")), F.col("_lo")))
    return out.withColumn(name, clipped).drop("_lo", "_hi")


def top_and_bottom(
    df: DataFrame, value: str, q: float, group: Sequence[str] = DATE, max_rows: int | None = None
) -> DataFrame:
    """Add k = max(floor(n q), 1) and the flags ``top`` and ``bottom``.

    Ties keep the first code at both ends.
    """
    out = with_aggregates(df, group, {"names": F.count(F.lit(1))}, max_rows)
    out = row_numbers(out, group, [F.col(value).desc(), F.col("code")], "_down", max_rows)
    out = row_numbers(out, group, [F.col(value), F.col("code")], "_up", max_rows)
    k = F.greatest(F.floor(F.col("names") * F.lit(q)), F.lit(1)).cast("long")
    return (
        out.withColumn("k", k)
        .withColumn("top", F.col("_down") <= F.col("k"))
        .withColumn("bottom", F.col("_up") <= F.col("k"))
        .drop("_down", "_up")
    )
