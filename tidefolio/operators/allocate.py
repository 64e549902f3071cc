"""Weights for many scenarios and dates in one job.

For each (scenario, date) the separable problem

    max  sum alpha w - gamma (w - ref)^2 - kappa |w - prev|
    s.t. sum w = 1,  lb <= w <= ub

has one unknown, the price nu of the budget. Each name's weight falls with nu
in straight pieces, so the total does too, and its breakpoints are known. A
running total over the breakpoints finds the piece where the total is 1, and
that piece gives nu exactly. No solver and no Python code runs per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidefolio.functions.cols import is_banned
from tidefolio.operators.crosssection import winsorise
from tidefolio.operators.groups import join_groups, running_sums, with_aggregates

KEYS = ("scenario_id", "date")
OPTIMAL = "optimal"
INFEASIBLE = "infeasible"


def prepare_alpha(
    names: DataFrame, tail: float = 0.01, group: Sequence[str] = ("date",), max_rows: int | None = None
) -> DataFrame:
    """Clip alpha to its tails, standardise it (population deviation), zero banned names.

    Banned names count in the quantiles and the scale. A date without spread
    keeps its clipped values.
    """
    out = winsorise(names, "alpha", "_clip", tail, group, max_rows)
    spread = {"_mean": F.avg("_clip"), "_std": F.stddev_pop("_clip")}
    out = with_aggregates(out, group, spread, max_rows)
    scaled = F.when(F.col("_std") > 1e-10, (F.col("_clip") - F.col("_mean")) / F.col("_std")).otherwise(F.col("_clip"))
    return out.withColumn("alpha", F.when(is_banned(F.col("status")), 0.0).otherwise(scaled)).drop("_clip", "_mean", "_std")


def return_alpha(alpha: Column, ic: float, vol: Column) -> Column:
    """Expected excess return: information coefficient x volatility x score."""
    return F.lit(float(ic)) * vol * alpha


def _clip(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(v, lo), hi)


def weight_at(nu: Column) -> Column:
    """The name's best weight when the budget costs ``nu``."""
    two_gamma = 2 * F.col("gamma")
    u = F.col("ref") + (F.col("alpha") - nu) / two_gamma
    t = F.coalesce(F.col("kappa"), F.lit(0.0)) / two_gamma
    prev = F.col("prev_weight")
    best = (
        F.when(prev.isNull(), u)
        .when(u > prev + t, u - t)
        .when(u < prev - t, u + t)
        .otherwise(prev)
    )
    return _clip(best, F.col("lb"), F.col("ub"))


def breakpoints() -> Column:
    """(nu, step): prices where the name's weight starts (+1) or stops (-1) to grow as nu falls."""
    two_gamma = 2 * F.col("gamma")
    lb, ub, prev = F.col("lb"), F.col("ub"), F.col("prev_weight")
    t = F.coalesce(F.col("kappa"), F.lit(0.0)) / two_gamma

    def at(level: Column, step: int) -> Column:
        nu = F.col("alpha") - two_gamma * (level - F.col("ref"))
        return F.struct(nu.alias("nu"), F.lit(step).alias("step"))

    kept = _clip(prev, lb, ub)
    free = F.array(at(lb, 1), at(ub, -1))
    sticky = F.array(at(lb - t, 1), at(kept - t, -1), at(kept + t, 1), at(ub + t, -1))
    return F.when(prev.isNull(), free).otherwise(sticky)


def price_steps(names: DataFrame, at: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """(at, nu, step, gamma, growing, starts): a group's breakpoints with running totals as the price falls.

    The group's weight at nu is its sum of lb plus (starts - nu * growing) / (2 gamma).
    """
    steps = (
        names.where(F.col("ub") > F.col("lb"))
        .select(*at, "gamma", F.explode(breakpoints()).alias("_b"))
        .select(*at, "gamma", "_b.nu", "_b.step")
        .groupBy(*at, "nu")
        .agg(F.sum("step").alias("step"), F.first("gamma").alias("gamma"))
    )
    return running_steps(steps, at, max_rows)


def running_steps(steps: DataFrame, at: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Add ``growing`` and ``starts`` to steps (at, nu, step, gamma) of distinct nu."""
    return running_sums(
        steps, list(at), [F.col("nu").desc()],
        {"growing": F.col("step"), "starts": F.col("step") * F.col("nu")},
        None if max_rows is None else 4 * max_rows,
    )


def mass() -> Column:
    """Weight of a group at a breakpoint; needs its lo."""
    return F.col("lo") + (F.col("starts") - F.col("nu") * F.col("growing")) / (2 * F.col("gamma"))


def before(level: Column) -> Column:
    """Whether a breakpoint is reached by the time the group weighs ``level``."""
    return mass() <= level + 1e-12


def price_of_level(totals: DataFrame, levels: DataFrame, at: Sequence[str]) -> DataFrame:
    """(at, nu, growing): the price at which a group weighs ``level``; levels are (at, lo, level)."""
    reached = (
        join_groups(totals, levels, at)
        .where(before(F.col("level")))
        .groupBy(*at)
        .agg(F.min_by(F.struct("nu", "growing", "starts", "gamma", "lo", "level"), "nu").alias("p"))
    )
    nu = F.when(
        F.col("p.growing") > 0, (F.col("p.starts") - 2 * F.col("p.gamma") * (F.col("p.level") - F.col("p.lo"))) / F.col("p.growing")
    ).otherwise(F.col("p.nu"))
    return reached.select(*at, nu.alias("nu"), F.col("p.growing").alias("growing"), F.col("p.gamma").alias("gamma"))


def budget_prices(names: DataFrame, keys: Sequence[str] = KEYS, max_rows: int | None = None) -> DataFrame:
    """(keys, nu, status): the price at which the weights of a group sum to 1."""
    at = list(keys)
    sides = names.groupBy(*at).agg(
        F.sum("lb").alias("lo"), F.sum("ub").alias("hi"), F.count_if(F.col("lb") > F.col("ub")).alias("crossed")
    )
    reached = price_of_level(price_steps(names, at, max_rows), sides.select(*at, "lo", F.lit(1.0).alias("level")), at)
    possible = (F.col("crossed") == 0) & (F.col("lo") <= 1 + 1e-9) & (F.col("hi") >= 1 - 1e-9)
    return sides.join(reached.select(*at, "nu"), at, "left").select(
        *at, "nu", F.when(possible, OPTIMAL).otherwise(INFEASIBLE).alias("status_code")
    )


def allocate(names: DataFrame, keys: Sequence[str] = KEYS, max_rows: int | None = None) -> DataFrame:
    """Add ``weight``, ``status_code`` and ``nu``.

    ``names`` holds alpha, ref, gamma (above 0, one per group), kappa,
    prev_weight (NULL before the first holding), lb and ub. Infeasible groups
    get weight 0. ``names`` is read twice; write it first if it is expensive.
    """
    priced = names.join(budget_prices(names, keys, max_rows), list(keys))
    raw = F.coalesce(weight_at(F.col("nu")), F.col("lb"))
    held = priced.withColumn(
        "weight", F.when(F.col("status_code") == OPTIMAL, F.greatest(raw, F.lit(0.0))).otherwise(0.0)
    )
    out = with_aggregates(held, keys, {"_sum": F.sum("weight")}, max_rows)
    return out.withColumn(
        "weight", F.when(F.col("_sum") > 1e-8, F.col("weight") / F.col("_sum")).otherwise(F.col("weight"))
    ).drop("_sum")


def allocation_inputs(names: DataFrame) -> DataFrame:
    """Add ref, gamma and kappa from the scenario parameters.

    Index-enhanced portfolios deviate from the benchmark, long-only ones from
    zero. ``cost`` (default 1, at least 0) weights the turnover penalty unless
    the scenario's ``liquidity_weighted_cost`` is false.
    """
    cost = F.greatest(F.coalesce("cost", F.lit(1.0)), F.lit(0.0)) if "cost" in names.columns else F.lit(1.0)
    weight = F.when(F.col("liquidity_weighted_cost") == 0, 1.0).otherwise(cost) if "liquidity_weighted_cost" in names.columns else cost
    bm = F.coalesce("bm_weight", F.lit(0.0)) if "bm_weight" in names.columns else F.lit(0.0)
    return names.withColumns(
        {
            "ref": F.when(F.col("strategy") == "index_enhance", bm).otherwise(0.0),
            "gamma": F.col("penalty"),
            "kappa": F.coalesce("turnover_penalty", F.lit(0.0)) * weight,
        }
    )


def carry_weights(current: DataFrame, last: DataFrame, keys: Sequence[str] = ("scenario_id",), max_rows: int | None = None) -> DataFrame:
    """Add ``prev_weight``: the last weights on today's names, missing as 0, summing to 1 again.

    A scenario without last weights keeps NULL.
    """
    before = last.select(*keys, "code", F.col("weight").alias("prev_weight"))
    started = before.select(*keys).distinct().withColumn("_started", F.lit(True))
    joined = current.drop("prev_weight").join(before, [*keys, "code"], "left").join(started, list(keys), "left")
    filled = joined.withColumn(
        "prev_weight", F.when(F.col("_started"), F.coalesce("prev_weight", F.lit(0.0)))
    )
    out = with_aggregates(filled, [*keys, "date"], {"_sum": F.sum("prev_weight")}, max_rows)
    return out.withColumn(
        "prev_weight", F.when(F.col("_sum") > 1e-8, F.col("prev_weight") / F.col("_sum")).otherwise(F.col("prev_weight"))
    ).drop("_sum", "_started")

