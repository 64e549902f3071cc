"""Names with everything an allocation needs, on the proxy panel's rebalance dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidefolio.operators import benchmark as bm, timeseries as ts, universe as uni
from tidefolio.plans import proxy_risk
from tidefolio.plans.proxy import stored
from tidefolio.session import cut_lineage
from tidefolio.sources.alpha import alpha_asof

INDEX = "hs300"


def names(
    spark: SparkSession, sf_dir: str, every: int = 6, first: int = 4, once: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(names, panel, calendar, bound): status, industry, alpha, bm_weight, prev_weight and cost.

    The names are written unless the caller reads them only ``once``.
    """
    panel, days, n = stored(spark, sf_dir)
    targets = days.where(F.col("day") % every == first).select("date")
    today = panel.join(F.broadcast(targets), "date", "left_semi")
    snap = uni.default_prev_weights(uni.filter_universe(uni.snapshot(today, INDEX)), max_rows=n)
    weights = bm.benchmark_weights(panel, INDEX, max_rows=n)
    known = bm.benchmark_asof(snap, targets, weights, max_rows=n).drop("bm_date")
    scored = alpha_asof(known, targets, proxy_risk.alpha(panel, days, n)).drop("alpha_date")
    costs = ts.impact_costs(panel, days, targets, snap, max_rows=n)
    found = scored.join(costs, ["date", "code"], "left")
    return found if once else cut_lineage(found), panel, days, n
