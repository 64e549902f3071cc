"""Weights to report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidefolio.functions import fixed as K
from tidefolio.operators import execution as ex, performance as pf

KEYS = ("scenario_id",)


def report_tables(
    daily: DataFrame, turnover: DataFrame, keys: Sequence[str] = KEYS, risk_free: float = K.RISK_FREE
) -> dict[str, DataFrame]:
    """timeseries, turnover, metrics, yearly and monthly_excess of a daily table."""
    return {
        "timeseries": daily.select(
            *keys, "date", "nav", "bm_nav", "excess_nav",
            F.col("drawdown").alias("port_drawdown"), "excess_drawdown", F.col("ret").alias("port_ret"), "bm_ret",
        ),
        "turnover": turnover.where(F.col("turnover").isNotNull()),
        "metrics": pf.tall_metrics(daily, keys, risk_free),
        "yearly": pf.yearly_breakdown(daily, keys),
        "monthly_excess": pf.monthly_returns(daily, keys),
    }


def set_based(
    weights: DataFrame,
    calendar: DataFrame,
    panel: DataFrame,
    benchmark: DataFrame,
    cost_buy: float = K.BUY_COST,
    cost_sell: float = K.SELL_COST,
    keys: Sequence[str] = KEYS,
    max_rows: int | None = None,
) -> DataFrame:
    """Daily table of every strategy from what its orders fill, each period starting from its last targets."""
    nav = ex.drift_nav(weights, calendar, ex.trade_prices(panel), cost_buy, cost_sell, keys, max_rows=max_rows)
    return pf.against_benchmark(nav, benchmark, keys)
