"""A carried rebalance that was stopped goes on where it was."""

from datetime import date, timedelta

import pytest

from tidefolio.operators import bounds as bd
from tidefolio.operators.calendar import trading_calendar
from tidefolio.plans import rebalance
from tidefolio.session import new_table_path

SCENARIOS = [bd.scenario("a", "alpha_max", weight_upper=0.6, turnover_penalty=0.1), bd.scenario("never", "alpha_max", weight_upper=0.1)]


def panel(spark):
    rows = []
    for d in range(25):
        for c in range(4):
            p = 10.0 + c + 0.3 * ((d * (c + 3)) % 7)
            rows.append((date(2024, 1, 1) + timedelta(d), f"{c:06d}.SZ", p, p - 0.1, p, p, p, p * 1.1, p * 0.9, "交易", 1000.0 + c, 1e6, 1e6, 1e6, "i", 0, 0, 0, 0, 500))
    return spark.createDataFrame(
        rows,
        "date date, code string, close double, pre_close double, adj_close double, adj_vwap double, vwap double, limit_up double, limit_down double, "
        "trade_status string, amount double, total_mv double, float_mv double, free_mv double, industry_l1 string, is_hs300 int, is_zz500 int, is_zz1000 int, is_st int, list_days int",
    )


def test_stopped_run_goes_on(spark, monkeypatch):
    p = panel(spark)
    days = trading_calendar(p)
    alpha = p.selectExpr("date", "code", "close - 12 AS alpha")

    def run(store=None):
        weights, states = rebalance.run_rebalance(p, days, alpha, SCENARIOS, "all", every=8, max_rows=100, store=store)
        return sorted((r.scenario_id, r.date, r.code, round(r.weight, 9)) for r in weights.collect()), states.count()

    whole = run()
    assert {r[0] for r in whole[0]} == {"a"} and whole[1] == 8
    store = new_table_path(spark, "stopped")
    solve, calls = rebalance.al.allocate, []

    def dies(*args, **how):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return solve(*args, **how)

    monkeypatch.setattr(rebalance.al, "allocate", dies)
    with pytest.raises(RuntimeError):
        run(store)
    assert len(calls) == 3
    assert run(store) == whole
    assert len(calls) == 3 + 2  # two of four dates were finished
