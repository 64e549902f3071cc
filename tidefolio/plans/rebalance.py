"""The rebalance job: panel, alpha and scenarios to weights on every rebalance date."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidefolio.functions import fixed as K
from tidefolio.operators import (
    allocate as al,
    benchmark as bm,
    bounds as bd,
    calendar as cal,
    coupled as cp,
    risk as rk,
    timeseries as ts,
    universe as uni,
)
from tidefolio.session import cut_lineage, new_table_path
from tidefolio.sources.alpha import alpha_asof

KEYS = ["scenario_id", "date"]


def rebalance_names(
    panel: DataFrame,
    calendar: DataFrame,
    alpha: DataFrame,
    index: str,
    targets: DataFrame,
    exclude_bj: bool = True,
    exclude_st: bool = True,
    top_n: int | None = None,
    risk_dates: DataFrame | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Names of all rebalance dates with status, alpha, bm_weight and cost.

    With ``risk_dates`` (date, rebal_date) the dates a risk model does not
    cover are left out.
    """
    if risk_dates is not None:
        targets = targets.join(F.broadcast(risk_dates.select("date")), "date", "left_semi")
    today = panel.join(F.broadcast(targets), "date", "left_semi")
    names = uni.filter_universe(uni.snapshot(today, index), exclude_bj, exclude_st, top_n)
    if index in K.INDEX_FLAGS:
        weights = bm.benchmark_weights(panel, index, max_rows=max_rows)
        names = bm.benchmark_asof(names, targets, weights, max_rows=max_rows).drop("bm_date")
    else:
        names = names.withColumn("bm_weight", F.lit(0.0))
    scored = alpha_asof(names, targets, alpha).drop("alpha_date")
    costs = ts.impact_costs(panel, calendar, targets, names, max_rows=max_rows)
    return scored.join(costs, ["date", "code"], "left")


def run_rebalance(
    panel: DataFrame,
    calendar: DataFrame,
    alpha: DataFrame,
    scenarios: Sequence[Mapping],
    index: str,
    start: date | str | None = None,
    end: date | str | None = None,
    every: int = 10,
    carry: bool = True,
    risk: tuple[DataFrame, DataFrame] | None = None,
    rounds: int = 0,
    max_rows: int | None = None,
    store: str | None = None,
    **universe,
) -> tuple[DataFrame, DataFrame]:
    """(weights, statuses) of every scenario on every k-th trading date.

    ``risk`` holds exposures and covariance: exposures enter the style limits,
    and dates without coverage are skipped. With ``rounds`` the group limits
    are priced for at most that many rounds, else only the bounds of names
    hold. Without ``carry`` no date depends on another and all are one job.
    With it each date starts from the last feasible weights, so dates follow
    one another, one job per date over all scenarios; an infeasible date keeps
    the last weights on today's names, and before the first feasible one it has
    a status but no weights. ``panel`` should be a stored table. With ``store``,
    a folder, the names and every finished date are kept there: a run that was
    stopped goes on after its last finished date when it is started again with
    the same arguments.
    """
    targets = cal.rebalance_dates(calendar, every, start, end)
    covered, exposures = None, None
    if risk is not None:
        covered = cut_lineage(rk.risk_dates(targets, risk[1]))
    # one partition per date: a step of the carried job reads its own date alone
    store = store or new_table_path(panel.sparkSession, "rebalance")
    names = _kept_step(
        panel.sparkSession, f"{store}/names",
        lambda: rebalance_names(panel, calendar, alpha, index, targets, risk_dates=covered, max_rows=max_rows, **universe), ["date"],
    )
    if risk is not None and rounds:
        exposures = cut_lineage(rk.exposures_asof(names, covered, risk[0]))

    def solve(rows: DataFrame) -> DataFrame:
        inputs = cut_lineage(al.allocation_inputs(bd.tradable_alpha(bd.name_bounds(rows))))
        if not rounds:
            return al.allocate(inputs, max_rows=max_rows)
        limits = bd.group_bounds(inputs, exposures)
        return cp.allocate_coupled(inputs, limits, exposures, rounds, max_rows=max_rows)

    spread = bd.with_scenarios(names, scenarios)
    if not carry:
        out = cut_lineage(solve(spread.withColumn("prev_weight", F.lit(None).cast("double"))))
        return out, out.select(*KEYS, "status_code").distinct()
    return _run_carried(spread, names, solve, max_rows, store)


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _kept_step(spark: SparkSession, path: str, make: Callable[[], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The table at the path; made only if no earlier run finished it."""
    if not _finished(spark, path):
        make().write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)
    return spark.read.parquet(path)


def _run_carried(spread: DataFrame, names: DataFrame, solve, max_rows: int | None, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    spark = names.sparkSession
    store = store or new_table_path(spark, "rebalance")
    last = spread.select("scenario_id", "code", F.lit(0.0).alias("weight")).where(F.lit(False))
    dates = [r[0] for r in names.select("date").distinct().orderBy("date").collect()]
    feasible = F.col("status_code") == al.OPTIMAL

    def kept(solved: DataFrame, last: DataFrame) -> DataFrame:
        """Today's weights; a scenario that failed keeps its last ones on today's names."""
        before = last.select("scenario_id", "code", F.col("weight").alias("_last"))
        held = last.select("scenario_id").distinct().withColumn("_held", F.lit(True))
        step = solved.join(before, ["scenario_id", "code"], "left").join(held, "scenario_id", "left")
        step = step.where(feasible | F.col("_held"))
        return step.withColumn("weight", F.when(feasible, F.col("weight")).otherwise(F.coalesce("_last", F.lit(0.0)))).drop("_last", "_held")

    def next_last(solved: DataFrame, last: DataFrame) -> DataFrame:
        """What the next date starts from: a scenario that failed today goes on from its last feasible weights."""
        fresh = solved.where(feasible).select("scenario_id", "code", "weight")
        return fresh.unionByName(last.join(fresh.select("scenario_id").distinct(), "scenario_id", "left_anti"))

    for i, day in enumerate(dates):
        today, last_, at = spread.where(F.col("date") == F.lit(day)), last, f"{i:06d}"
        solved = _kept_step(spark, f"{store}/solved/{at}", lambda: solve(al.carry_weights(today, last_, max_rows=max_rows)))
        _kept_step(spark, f"{store}/weights/{at}", lambda: kept(solved, last_))
        last = _kept_step(spark, f"{store}/last/{at}", lambda: next_last(solved, last_))
    weights, solved = (spark.read.parquet(*[f"{store}/{kind}/{i:06d}" for i in range(len(dates))]) for kind in ("weights", "solved"))
    return weights, solved.select(*KEYS, "status_code").distinct()
