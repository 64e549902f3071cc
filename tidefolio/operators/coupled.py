"""Weights under limits on groups: prices on the limits, found by rounds.

Each limited sum (industry, style, members, turnover) gets a price that is
taken from the alphas of its names; with prices fixed the problem is the
separable one of allocate.py. A round allocates all scenarios and dates at
once, measures the sums, and moves each price by its violation. Only the prices
pass from round to round: one small row per limit. The result meets the limits
up to a tolerance, which audit.py measures; it is exact only in the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidefolio.functions import fixed as K
from tidefolio.operators.allocate import KEYS, OPTIMAL, allocate
from tidefolio.session import cut_lineage

NOT_CONVERGED = "not_converged"
LINEAR = ("industry", "constituent", "style")


def coefficients(names: DataFrame, limits: DataFrame, exposures: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, kind, key, code, a) of the linear limits, each limit's a scaled to norm 1, and its norm."""
    at = list(keys)
    parts = names.select(*at, F.lit("industry").alias("kind"), F.col("industry").alias("key"), "code", F.lit(1.0).alias("a")).unionByName(
        names.where("is_constituent").select(
            *at, F.lit("constituent").alias("kind"), F.lit("members").alias("key"), "code", F.lit(1.0).alias("a")
        )
    )
    if exposures is not None:
        styles = names.select(*at, "code").join(
            exposures.where(F.col("factor").isin(*K.STYLE_FACTORS)).select("date", "code", F.col("factor").alias("key"), F.col("x").alias("a")),
            ["date", "code"],
        )
        parts = parts.unionByName(styles.select(*at, F.lit("style").alias("kind"), "key", "code", "a"))
    row = [*at, "kind", "key"]
    limited = parts.join(limits.select(*row), row, "left_semi")
    norms = limited.groupBy(*row).agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("norm"))
    return limited.join(norms.where(F.col("norm") > 0), row).withColumn("a", F.col("a") / F.col("norm"))


def _priced_names(names: DataFrame, coefs: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alpha less the prices of the name's limits, turnover and deviation prices in kappa and gamma."""
    at = list(keys)
    paid = (
        coefs.join(prices.select(*at, "kind", "key", "at_price"), [*at, "kind", "key"])
        .groupBy(*at, "code")
        .agg(F.sum(F.col("a") * F.col("at_price")).alias("_paid"))
    )
    whole = prices.groupBy(*at).agg(
        F.max(F.when(F.col("kind") == "turnover", F.col("at_price") / F.col("norm"))).alias("_turn"),
        F.max(F.when(F.col("kind") == "deviation", F.col("at_price"))).alias("_dev"),
    )
    zero = F.lit(0.0)
    return (
        names.join(paid, [*at, "code"], "left")
        .join(whole, at, "left")
        .withColumns(
            {
                "alpha": F.col("alpha") - F.coalesce("_paid", zero),
                "kappa": F.col("kappa") + F.coalesce("_turn", zero),
                "gamma": F.col("gamma") + F.coalesce("_dev", zero),
            }
        )
        .drop("_paid", "_turn", "_dev")
    )


def _sums(weights: DataFrame, coefs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, kind, key, value): scaled linear sums, scaled turnover, distance to the reference."""
    at = list(keys)
    linear = (
        coefs.join(weights.select(*at, "code", "weight"), [*at, "code"])
        .groupBy(*at, "kind", "key")
        .agg(F.sum(F.col("a") * F.col("weight")).alias("value"))
    )
    w = F.col("weight")
    whole = weights.groupBy(*at).agg(
        (F.sum(F.abs(w - F.col("prev_weight"))) / F.sqrt(F.count(F.lit(1)))).alias("turnover|two_way"),
        F.sqrt(F.sum((w - F.col("ref")) * (w - F.col("ref")))).alias("deviation|l2"),
    )
    cols = ["turnover|two_way", "deviation|l2"]
    rest = whole.unpivot(at, [F.col(f"`{c}`") for c in cols], "_n", "value").select(
        *at, F.split("_n", r"\|")[0].alias("kind"), F.split("_n", r"\|")[1].alias("key"), "value"
    )
    return linear.unionByName(rest)


def allocate_coupled(
    names: DataFrame,
    limits: DataFrame,
    exposures: DataFrame | None = None,
    rounds: int = 100,
    tolerance: float = 1e-4,
    keys: Sequence[str] = KEYS,
    max_rows: int | None = None,
) -> DataFrame:
    """Add ``weight`` and ``status_code`` under the limits of group_bounds.

    A group leaves the rounds once no scaled limit of it is broken by more than
    ``tolerance``. Groups that still break one after the last round keep their
    weights under the status ``not_converged``; limits that contradict each
    other end so too. Steps are 2 gamma over a bound of the squared norm of all
    limits; accelerated, and restarted where a price turns back.
    """
    at = list(keys)
    row = [*at, "kind", "key"]
    names, limits = cut_lineage(names), cut_lineage(limits)
    coefs = cut_lineage(coefficients(names, limits, exposures, keys))
    sizes = names.groupBy(*at).agg(F.first("gamma").alias("gamma"), F.count(F.lit(1)).alias("_n"))
    norms = coefs.groupBy(*row).agg(F.first("norm").alias("norm"))
    known = limits.join(norms, row, "left").join(sizes, at)
    known = known.withColumn(
        "norm", F.when(F.col("kind") == "turnover", F.sqrt("_n")).when(F.col("kind") == "deviation", F.lit(1.0)).otherwise(F.col("norm"))
    ).where(F.col("norm").isNotNull())
    singles = known.groupBy(*at).agg(
        (F.count_if(F.col("kind").isin("style", "constituent", "turnover")) + 1).alias("_blocks")
    )
    zero = F.lit(0.0)
    prices = cut_lineage(
        known.join(singles, at).select(
            *row, (F.col("lo") / F.col("norm")).alias("lo"), (F.col("hi") / F.col("norm")).alias("hi"), "norm", "gamma",
            (2 * F.col("gamma") / F.col("_blocks")).alias("step"), zero.alias("price"), zero.alias("at_price"), zero.alias("gap"),
            F.lit(0).alias("age"),
        )
    )
    done = prices.where(F.lit(False)).withColumn("used", zero)
    still = cut_lineage(prices.select(*at).distinct())
    for _ in range(rounds):
        live = names.join(still, at, "left_semi")
        weights = allocate(_priced_names(live, coefs, prices, keys), keys, max_rows)
        moved = cut_lineage(_move(prices, _sums(weights.where(F.col("status_code") == OPTIMAL), coefs, keys), row))
        still = cut_lineage(moved.groupBy(*at).agg(F.max("gap").alias("_gap")).where(F.col("_gap") >= tolerance).select(*at))
        done = done.unionByName(moved.join(still, at, "left_anti"))
        prices = cut_lineage(moved.join(still, at, "left_semi"))
        if prices.isEmpty():
            break
    last = done.unionByName(prices, allowMissingColumns=True)
    out = allocate(_priced_names(names, coefs, last.withColumn("at_price", F.col("used")), keys), keys, max_rows)
    kept = out.drop("alpha", "kappa", "gamma").join(still.withColumn("_open", F.lit(True)), at, "left")
    late = F.col("_open") & (F.col("status_code") == OPTIMAL)
    kept = kept.withColumn("status_code", F.when(late, F.lit(NOT_CONVERGED)).otherwise(F.col("status_code"))).drop("_open")
    return kept.join(names.select(*at, "code", "alpha", "kappa", "gamma"), [*at, "code"])


def _move(prices: DataFrame, sums: DataFrame, row: Sequence[str]) -> DataFrame:
    """Prices after one round; ``used`` keeps the prices the round was allocated at.

    A price is one signed number: above zero it holds the sum below hi, under
    zero above lo. Between the two sides it rests at zero.
    """
    p = F.col("at_price")
    v = F.col("value")
    inf = F.lit(float("inf"))
    hi, lo = F.coalesce("hi", inf), F.coalesce("lo", -inf)
    over, under = p + F.col("step") * (v - hi), p + F.col("step") * (v - lo)
    linear = F.when(over > 0, over).when(under < 0, under).otherwise(0.0)
    # the distance to the reference falls as one over gamma + price
    ball = F.greatest((F.col("gamma") + p) * v / F.col("hi") - F.col("gamma"), F.lit(0.0))
    new = F.when(v.isNull(), p).when(F.col("kind") == "deviation", ball).otherwise(linear)
    age = F.col("age") + 1
    back = (F.col("_new") - F.col("price")) * (F.col("_new") - p) < 0
    ahead = F.col("_new") + (F.col("_age") - 1) / (F.col("_age") + 2) * (F.col("_new") - F.col("price"))
    signed = (
        F.when(F.col("kind") == "deviation", F.col("_new"))
        .when(F.col("hi").isNull(), F.least(ahead, F.lit(0.0)))
        .when(F.col("lo").isNull(), F.greatest(ahead, F.lit(0.0)))
        .otherwise(ahead)
    )
    return (
        prices.drop("used")
        .join(sums, list(row), "left")
        .withColumn("_new", new)
        .withColumn("_age", F.when(back, 1).otherwise(age))
        .select(
            *row, "lo", "hi", "norm", "gamma", "step",
            F.col("_new").alias("price"),
            signed.alias("at_price"),
            F.coalesce(F.greatest(v - hi, lo - v, F.lit(0.0)), F.lit(0.0)).alias("gap"),
            F.col("_age").cast("int").alias("age"),
            p.alias("used"),
        )
    )
