"""Measures of given weights: concentration, groups, objective, limits kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import is_banned
from tidefolio.operators.groups import top_rows

KEYS = ("scenario_id", "date")
HELD = 1e-6


def concentration(weights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positions, sum, largest weight, squared sum, member weight, active 1- and 2-norm."""
    w = F.col("weight")
    aggs = [
        F.count_if(w > HELD).alias("positions"),
        F.sum(w).alias("total"),
        F.max(w).alias("largest"),
        F.sum(w * w).alias("hhi"),
        F.sum(F.when(F.col("is_constituent"), w).otherwise(0.0)).alias("member_weight"),
    ]
    if "bm_weight" in weights.columns:
        active = w - F.coalesce("bm_weight", F.lit(0.0))
        aggs += [F.sum(F.abs(active)).alias("active_l1"), F.sqrt(F.sum(active * active)).alias("active_l2")]
    return weights.groupBy(*keys).agg(*aggs)


def industry_weights(weights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, industry, weight, active)."""
    w = F.col("weight")
    bm = F.coalesce("bm_weight", F.lit(0.0)) if "bm_weight" in weights.columns else F.lit(0.0)
    return weights.groupBy(*keys, F.coalesce("industry", F.lit(K.UNKNOWN_INDUSTRY)).alias("industry")).agg(
        F.sum(w).alias("weight"), F.sum(w - bm).alias("active")
    )


def top_holdings(weights: DataFrame, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """The n largest positions with percentages; ties keep the first code."""
    best = top_rows(weights, keys, [F.col("weight").desc(), F.col("code")], n)
    out = [
        *keys, "code", "weight", (F.col("weight") * 100).alias("weight_pct"), "industry", "is_constituent",
    ]
    if "bm_weight" in weights.columns:
        bm = F.coalesce("bm_weight", F.lit(0.0)) * 100
        out += [bm.alias("bm_weight_pct"), (F.col("weight") * 100 - bm).alias("active_pct")]
    return best.select(*out)


def objective_value(weights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Alpha, deviation penalty, turnover penalty and their total per group."""
    w, ref, prev = F.col("weight"), F.col("ref"), F.col("prev_weight")
    alpha = F.sum(F.col("alpha") * w)
    deviation = F.sum(F.col("gamma") * (w - ref) * (w - ref))
    cost = F.coalesce(F.sum(F.col("kappa") * F.abs(w - prev)), F.lit(0.0))
    return weights.groupBy(*keys).agg(
        alpha.alias("alpha_term"), deviation.alias("penalty_term"), cost.alias("turnover_term"),
        (alpha - deviation - cost).alias("objective"),
    )


def constraint_values(weights: DataFrame, exposures: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, kind, key, value) of every sum that group_bounds can limit."""
    at = list(keys)
    w, prev = F.col("weight"), F.col("prev_weight")
    bm = F.coalesce("bm_weight", F.lit(0.0)) if "bm_weight" in weights.columns else F.lit(0.0)
    industry = weights.groupBy(*at, "industry").agg(F.sum(w).alias("value")).select(
        *at, F.lit("industry").alias("kind"), F.col("industry").alias("key"), "value"
    )
    whole = weights.groupBy(*at).agg(
        F.sum(F.when(F.col("is_constituent"), w).otherwise(0.0)).alias("constituent|members"),
        F.sum(F.abs(w - prev)).alias("turnover|two_way"),
        F.sqrt(F.sum((w - bm) * (w - bm))).alias("deviation|l2"),
    )
    names = ["constituent|members", "turnover|two_way", "deviation|l2"]
    sums = whole.unpivot(at, [F.col(f"`{n}`") for n in names], "_n", "value").select(
        *at, F.split("_n", r"\|")[0].alias("kind"), F.split("_n", r"\|")[1].alias("key"), "value"
    )
    out = industry.unionByName(sums)
    if exposures is not None:
        styles = (
            weights.where(w != 0)
            .join(exposures.where(F.col("factor").isin(*K.STYLE_FACTORS)), ["date", "code"])
            .groupBy(*at, "factor")
            .agg(F.sum(w * F.col("x")).alias("value"))
        )
        out = out.unionByName(styles.select(*at, F.lit("style").alias("kind"), F.col("factor").alias("key"), "value"))
    return out


def audit(weights: DataFrame, limits: DataFrame, exposures: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, kind, key, value, lo, hi, violation) for every limit.

    Besides the group limits: the budget, and per group the worst name against
    its bounds and the largest banned weight.
    """
    at = list(keys)
    w = F.col("weight")
    values = constraint_values(weights, exposures, keys)
    joined = limits.join(values, [*at, "kind", "key"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    zero = F.lit(0.0)
    names = weights.groupBy(*at).agg(
        F.sum(w).alias("budget"),
        F.max(F.greatest(w - F.col("ub"), F.col("lb") - w, zero)).alias("names"),
        F.max(F.when(is_banned(F.col("status")), w).otherwise(zero)).alias("banned"),
    )
    fixed = names.unpivot(at, ["budget", "names", "banned"], "kind", "value").select(
        *at, "kind", F.lit("all").alias("key"),
        F.when(F.col("kind") == "budget", 1.0).otherwise(0.0).alias("lo"),
        F.when(F.col("kind") == "budget", 1.0).otherwise(0.0).alias("hi"), "value",
    )
    return fixed.unionByName(joined.select(*at, "kind", "key", "lo", "hi", "value")).withColumn(
        "violation",
        F.greatest(F.col("value") - F.col("hi"), F.col("lo") - F.col("value"), zero),
    )


def turnover(weights: DataFrame, keys: Sequence[str] = ("scenario_id",)) -> DataFrame:
    """(keys, date, turnover): sum of absolute changes since the previous rebalance.

    A name that leaves counts with its whole last weight. Each weight is
    compared with the one a rebalance earlier or, if gone, sent to the next
    rebalance as a sale; the first date has no turnover.
    """
    by_keys = Window.partitionBy(*keys).orderBy("date")
    dates = weights.select(*keys, "date").distinct().withColumns(
        {"_prev": F.lag("date").over(by_keys), "_next": F.lead("date").over(by_keys)}
    )
    changes = weights.select(*keys, "date", "code", F.col("weight").alias("_w")).join(dates, [*keys, "date"])
    moved = changes.select(*keys, "date", "code", "_w").unionByName(
        changes.where(F.col("_next").isNotNull()).select(*keys, F.col("_next").alias("date"), "code", (-F.col("_w")).alias("_w"))
    )
    # the signed weights of a (date, code) add up to its change
    net = moved.groupBy(*keys, "date", "code").agg(F.sum("_w").alias("_d"))
    sums = net.groupBy(*keys, "date").agg(F.sum(F.abs("_d")).alias("turnover"))
    return dates.join(sums, [*keys, "date"]).select(
        *keys, "date", F.when(F.col("_prev").isNotNull(), F.col("turnover")).alias("turnover")
    )


def batch_summary(weights: DataFrame, statuses: DataFrame, keys: Sequence[str] = ("scenario_id",)) -> DataFrame:
    """(keys, periods, failed, mean_positions, mean_turnover); the first turnover counts as 0."""
    moves = turnover(weights, keys).groupBy(*keys).agg(F.avg(F.coalesce("turnover", F.lit(0.0))).alias("mean_turnover"))
    counts = weights.groupBy(*keys, "date").agg(F.count_if(F.col("weight") > HELD).alias("_n")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"), F.avg("_n").alias("mean_positions")
    )
    failed = statuses.groupBy(*keys).agg(F.count_if(F.col("status_code") != "optimal").alias("failed"))
    return counts.join(failed, list(keys)).join(moves, list(keys)).select(
        *keys, "periods", "failed", "mean_positions", "mean_turnover"
    )
