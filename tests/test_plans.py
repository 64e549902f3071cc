"""Plans: no Python in the data path, no window over a whole fact table, pruned scans."""

import re

import pytest

from tidefolio.catalog import queries

SF = "/root/testdata/sf0.001"
QUICK = [
    "panel_rows", "trade_status", "universe_top_by_cap", "average_daily_value", "benchmark_weights", "benchmark_return",
    "forward_returns", "impact_cost", "average_tie_ranks", "decay_smoothing", "calibration_signals", "risk_exposures",
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUICK)
def test_plan_stays_in_the_engine(spark, name):
    plan = _plan(queries()[name](spark, SF))
    assert not re.search(r"PythonUDF|EvalPython|InPandas|InArrow", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", QUICK)
def test_windows_without_key_only_number_dates(spark, name):
    """A single-partition exchange holds calendar dates or one-row aggregates only."""
    plan = _plan(queries()[name](spark, SF))
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = " ".join(lines[i + 1 : i + 3])
            assert "HashAggregate(keys=[date" in below or "keys=[]" in below or "Project [date" in below, below


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(queries()["panel_missing_years"](spark, SF))
    assert "l_extendedprice" not in plan
    plan = _plan(queries()["rebalance_calendar"](spark, SF))
    scans = [s for s in plan.splitlines() if "FileScan" in s]
    assert scans and all(s.split("ReadSchema: ")[1].startswith("struct<l_shipdate:") for s in scans)


def test_asof_weights_make_only_asked_days(spark):
    """Values are spread over numbers of asked dates, never over days."""
    plan = _plan(queries()["benchmark_weights_asof"](spark, SF))
    assert "sequence(_from" in plan and "sequence(day" not in plan


def test_year_states_read_no_data_column(spark):
    plan = _plan(queries()["panel_year_states"](spark, SF))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)) == {"struct<>"}


def test_top_rows_are_cut_before_the_shuffle(spark):
    plan = _plan(queries()["universe_top_by_cap"](spark, SF))
    assert "WindowGroupLimit" in plan


def test_holdings_meet_exposures_once(spark):
    """The costly join of the risk decomposition; both ends of the covariance are looked up in its sums."""
    from tidefolio.operators.risk import risk_decomposition
    from tidefolio.session import cut_lineage

    day = "date '2024-01-02' AS date"
    weights = spark.sql(f"SELECT {day}, 'a' AS code, 0.5D AS weight UNION ALL SELECT {day}, 'b', -0.5D")
    exposures = cut_lineage(spark.sql(f"SELECT {day}, 'a' AS code, 'Size' AS factor, 2.0D AS x UNION ALL SELECT {day}, 'b', 'Beta', 1.0D"))
    specific = spark.sql(f"SELECT {day}, 'a' AS code, 0.04D AS spec_var UNION ALL SELECT {day}, 'b', NULL")
    pairs = [("Size", "Size", 1.0), ("Size", "Beta", 0.5), ("Beta", "Size", 0.5), ("Beta", "Beta", 2.0), ("Size", "Value", 9.0)]
    cov = spark.createDataFrame(pairs, "factor_i string, factor_j string, cov double").selectExpr("date '2024-01-01' AS rebal_date", "*")
    dates = spark.sql(f"SELECT {day}, date '2024-01-01' AS rebal_date")
    out = risk_decomposition(weights, exposures, specific, cov, dates)
    row = out.first()
    assert row["factor_risk"] == pytest.approx(1.0 * 1 + 2 * (1.0 * -0.5) * 0.5 + 0.25 * 2)
    assert row["specific_risk"] == pytest.approx(0.25 * 0.04)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*factor", plan)) == 1


def test_deferred_sales_join_on_code_and_day(spark):
    from datetime import date

    from tidefolio.operators.execution import deferred_sales

    d = [date(2024, 1, i) for i in range(1, 8)]
    orders = spark.createDataFrame(
        [("s", d[0], d[3], "a", "sell", True, True), ("s", d[0], d[3], "b", "sell", True, True), ("s", d[0], None, "c", "sell", True, True), ("s", d[0], d[3], "e", "buy", True, True)],
        "scenario_id string, exec_date date, next_exec_date date, code string, side string, blocked boolean, priced boolean",
    )
    closed = {"a": (0, 1), "b": (0, 1, 2, 3), "c": (0, 2)}
    rows = [(x, c, None if (c, i) == ("c", 1) else 1.0, i in no) for c, no in closed.items() for i, x in enumerate(d)]
    prices = spark.createDataFrame(rows, "date date, code string, price double, cant_sell boolean")
    out = deferred_sales(orders, prices)
    assert {r["code"]: r["sale_date"] for r in out.collect()} == {"a": d[2], "b": None, "c": d[3]}
    joins = re.findall(r"(?:SortMergeJoin|HashJoin) \[([^\]]*)\]", _plan(out))
    assert joins and all("exec_date" in j and "code" in j for j in joins)


def test_reports_are_made_from_one_panel_and_one_book(spark, monkeypatch):
    """Every further panel or book is the query's whole input read, dealt and written once more."""
    from tidefolio.catalog import performance
    from tidefolio.operators import execution

    made = []

    def counted(name, make):
        return lambda *args, **kwargs: made.append(name) or make(*args, **kwargs)

    monkeypatch.setattr(performance, "stored", counted("panel", performance.stored))
    monkeypatch.setattr(execution, "trade_book", counted("book", execution.trade_book))
    for query in (performance.report_store, performance.report_store_timeseries):
        made.clear()
        assert query(spark, "/root/testdata/sf0.001").count() > 0
        assert sorted(made) == ["book", "panel"]
