"""Scenario parameters and the bounds they put on names and groups.

Parameters are columns, so one job covers every scenario and date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import bound_for, bounds_map, is_banned
from tidefolio.operators.groups import repeat_for

# Parameter defaults of the two strategies.
LONG_ONLY = {
    "strategy": "alpha_max", "weight_upper": 0.02, "industry_upper": 0.20, "min_constituent_ratio": 0.0,
    "penalty": 0.05, "style_bound": 1.0, "max_turnover": None, "turnover_penalty": 0.0, "liquidity_weighted_cost": True,
}
INDEX_ENHANCED = {
    "strategy": "index_enhance", "weight_upper": 0.05, "industry_active_bound": 0.05, "min_constituent_ratio": 0.80,
    "penalty": 10.0, "style_bound": 0.30, "max_turnover": 0.20, "turnover_penalty": 0.0, "weight_diff_l2_bound": None,
    "liquidity_weighted_cost": True,
}
NUMBERS = (
    "weight_upper", "industry_upper", "industry_active_bound", "min_constituent_ratio", "penalty",
    "max_turnover", "turnover_penalty", "weight_diff_l2_bound", "liquidity_weighted_cost",
)


def scenario(scenario_id: str, strategy: str, **changes) -> dict:
    """Parameters of one scenario: the strategy's defaults and the changes."""
    base = {"alpha_max": LONG_ONLY, "index_enhance": INDEX_ENHANCED}
    if strategy not in base:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {sorted(base)}")
    unknown = set(changes) - set(NUMBERS) - {"style_bound"}
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    return {"scenario_id": scenario_id, **base[strategy], **changes}


def with_scenarios(df: DataFrame, scenarios: Sequence[Mapping] | DataFrame) -> DataFrame:
    """Repeat each row for every scenario, with its parameters as columns.

    A table of scenarios has scenario_id, strategy, the numbers and
    style_bounds (map of factor to bound); what it lacks is unset.
    """
    if isinstance(scenarios, DataFrame):
        unset = {n: F.lit(None).cast("double") for n in NUMBERS} | {"style_bounds": F.lit(None).cast("map<string,double>")}
        known = scenarios.withColumns({n: c for n, c in unset.items() if n not in scenarios.columns})
        return repeat_for(df, known.select("scenario_id", "strategy", *[F.col(n).cast("double").alias(n) for n in NUMBERS], "style_bounds"))

    def cell(s: Mapping) -> Column:
        style = s.get("style_bound")
        bounds = F.lit(None).cast("map<string,double>") if style is None else bounds_map(style)
        numbers = [F.lit(None if s.get(n) is None else float(s[n])).cast("double").alias(n) for n in NUMBERS]
        return F.struct(
            F.lit(s["scenario_id"]).alias("scenario_id"), F.lit(s["strategy"]).alias("strategy"),
            *numbers, bounds.alias("style_bounds"),
        )

    return df.withColumn("_s", F.explode(F.array(*[cell(s) for s in scenarios]))).select("_s.*", *df.columns)


def name_bounds(names: DataFrame) -> DataFrame:
    """Add ``lb`` and ``ub`` of each name's weight.

    Banned names get 0. With previous weights a limit-up name may not be
    bought and a limit-down name may not be sold; one whose previous weight
    exceeds the cap cannot meet both and makes its date infeasible.
    """
    status, prev = F.col("status"), F.col("prev_weight")
    up = F.when((status == K.LIMIT_UP) & prev.isNotNull(), F.least("weight_upper", prev)).otherwise(F.col("weight_upper"))
    down = F.when((status == K.LIMIT_DOWN) & prev.isNotNull(), prev).otherwise(F.lit(0.0))
    return names.withColumn("lb", F.when(is_banned(status), 0.0).otherwise(down)).withColumn(
        "ub", F.when(is_banned(status), 0.0).otherwise(up)
    )


def tradable_alpha(names: DataFrame) -> DataFrame:
    """Alpha of banned names as 0."""
    return names.withColumn("alpha", F.when(is_banned(F.col("status")), 0.0).otherwise(F.col("alpha")))


def group_bounds(names: DataFrame, exposures: DataFrame | None = None, keys: Sequence[str] = ("scenario_id", "date")) -> DataFrame:
    """(keys, kind, key, lo, hi): limits on sums over names.

    industry: weight of an industry, absolute or around the benchmark's;
    constituent: weight of members; style: exposure, absolute or around the
    benchmark's; turnover: sum of changes, only with previous weights;
    deviation: distance to the benchmark in the 2-norm. NULL is no limit.
    """
    at = list(keys)
    enhanced = F.col("strategy") == "index_enhance"
    params = ["strategy", *NUMBERS, "style_bounds"]
    firsts = [F.first(p).alias(p) for p in params]
    bm = F.coalesce("bm_weight", F.lit(0.0)) if "bm_weight" in names.columns else F.lit(0.0)

    def row(kind: str, key: Column, lo: Column, hi: Column) -> list[Column]:
        return [*at, F.lit(kind).alias("kind"), key.alias("key"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi")]

    none = F.lit(None)
    industry = names.groupBy(*at, "industry").agg(F.sum(bm).alias("_bm"), *firsts)
    out = industry.select(
        *row(
            "industry", F.col("industry"),
            F.when(enhanced, F.col("_bm") - F.col("industry_active_bound")),
            F.when(enhanced, F.col("_bm") + F.col("industry_active_bound")).otherwise(F.col("industry_upper")),
        )
    )
    whole = names.groupBy(*at).agg(
        F.count_if("is_constituent").alias("_members"), F.count("prev_weight").alias("_prev"), *firsts
    )
    out = out.unionByName(
        whole.where((F.col("min_constituent_ratio") > 0) & (F.col("_members") > 0)).select(
            *row("constituent", F.lit("members"), F.col("min_constituent_ratio"), none)
        )
    ).unionByName(
        whole.where(F.col("max_turnover").isNotNull() & (F.col("_prev") > 0)).select(
            *row("turnover", F.lit("two_way"), none, F.col("max_turnover"))
        )
    ).unionByName(
        whole.where(F.col("weight_diff_l2_bound").isNotNull()).select(
            *row("deviation", F.lit("l2"), none, F.col("weight_diff_l2_bound"))
        )
    )
    if exposures is not None:
        held = names.where(F.col("style_bounds").isNotNull()).join(
            exposures.where(F.col("factor").isin(*K.STYLE_FACTORS)), ["date", "code"]
        )
        styles = held.groupBy(*at, "factor").agg(F.sum(bm * F.col("x")).alias("_bm"), *firsts)
        bound = bound_for(F.col("style_bounds"), F.col("factor"))
        centre = F.when(enhanced, F.col("_bm")).otherwise(F.lit(0.0))
        out = out.unionByName(styles.select(*row("style", F.col("factor"), centre - bound, centre + bound)))
    return out
