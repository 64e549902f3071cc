"""Figures of hand-made series, and the drift value of held weights."""

from datetime import date

import numpy as np
import pandas as pd
import pytest

from tidefolio.operators import performance as pf

RF = 1.02 ** (1 / 252) - 1


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(9)
    days = pd.bdate_range("2022-11-15", "2024-02-20")
    days = days[(days.month != 4) | (days.year != 2023)]  # one whole month without days
    ret, bm = rng.normal(0.0006, 0.01, len(days)), rng.normal(0.0003, 0.009, len(days))
    ret[0] = 0.0
    return pd.DataFrame({"scenario_id": "s", "date": days.date, "ret": ret, "bm_ret": bm})


@pytest.fixture(scope="module")
def daily(spark, series):
    return spark.createDataFrame(series, "scenario_id string, date date, ret double, bm_ret double")


def _dd(x):
    nav = np.cumprod(1 + x)
    return (nav / np.maximum.accumulate(nav) - 1).min()


def test_metrics(daily, series):
    row = pf.metrics(daily).first()
    r, b = series.ret.values, series.bm_ret.values
    e = r - b
    n = len(r)
    annual = np.prod(1 + r) ** (252 / n) - 1
    assert row.annual_return == pytest.approx(annual)
    assert row.annual_vol == pytest.approx(r.std(ddof=1) * 252**0.5)
    assert row.sharpe == pytest.approx((r.mean() - RF) / r.std(ddof=1) * 252**0.5)
    assert row.max_drawdown == pytest.approx(_dd(r))
    assert row.calmar == pytest.approx(annual / abs(_dd(r)))
    assert row.annual_excess_return == pytest.approx(e.mean() * 252)
    assert row.info_ratio == pytest.approx(e.mean() * 252 / (e.std(ddof=1) * 252**0.5))
    exc = np.cumprod(1 + r) / np.cumprod(1 + b)
    assert row.excess_max_drawdown == pytest.approx((exc / np.maximum.accumulate(exc) - 1).min())
    # 16 calendar months, the empty one counts as not won
    idx = pd.DatetimeIndex(series.date)
    m = (1 + series.set_index(idx)[["ret", "bm_ret"]]).resample("ME").prod() - 1
    x = m.ret - m.bm_ret
    assert len(x) == 16
    assert row.win_rate_monthly == pytest.approx((x > 0).mean())
    assert row.avg_monthly_excess == pytest.approx(x.mean())


def test_tall_metrics_measure_the_benchmark_against_zero(daily, series):
    tall = {r.metric: (r.portfolio, r.benchmark) for r in pf.tall_metrics(daily).collect()}
    assert len(tall) == 12
    assert tall["annual_excess_return"][1] == pytest.approx(series.bm_ret.mean() * 252)
    assert tall["max_drawdown"][1] == pytest.approx(_dd(series.bm_ret.values))


def test_yearly_rows(daily, series):
    rows = {r.year: r for r in pf.yearly_table(daily).collect()}
    assert set(rows) == {2022, 2023, 2024, None}
    g = series[pd.DatetimeIndex(series.date).year == 2023]
    p, b = np.prod(1 + g.ret) - 1, np.prod(1 + g.bm_ret) - 1
    y = rows[2023]
    assert (y.n_days, y.port_ret, y.bm_ret) == (len(g), pytest.approx(p), pytest.approx(b))
    assert y.excess_ret == pytest.approx((1 + p) / (1 + b) - 1)
    assert y.sharpe == pytest.approx(g.ret.mean() / g.ret.std() * 252**0.5)
    assert y.max_dd == pytest.approx(_dd(g.ret.values))
    assert rows[None].n_days == len(series) and rows[None].sharpe == pytest.approx(pf.metrics(daily).first().sharpe)


def test_single_day_year(spark):
    one = spark.createDataFrame([("s", date(2024, 1, 2), 0.01, 0.0)], "scenario_id string, date date, ret double, bm_ret double")
    row = pf.yearly_breakdown(one).first()
    assert (row.vol, row.sharpe, row.excess_te) == (0.0, 0.0, 0.0) and row.port_ret == pytest.approx(0.01)


def test_grid_and_win_rates(daily):
    months = pf.monthly_returns(daily)
    grid = {r.year: r for r in pf.monthly_grid(months).collect()}
    assert grid[2022].m1 is None and grid[2023].m4 == 0.0 and grid[2024].m3 is None
    rates = pf.win_rates(months).collect()
    assert len(rates) == 3 + 12 + 1
    total = next(r for r in rates if r.year is None and r.month_of_year is None)
    by_year = [r for r in rates if r.year is not None]
    assert total.excess_pct == pytest.approx(sum(r.excess_pct for r in by_year))


def test_lost_everything(spark):
    rows = [("s", date(2024, 1, d), r, 0.0) for d, r in ((2, 0.0), (3, -1.0), (4, 0.5))]
    df = spark.createDataFrame(rows, "scenario_id string, date date, ret double, bm_ret double")
    assert pf.metrics(df).first().max_drawdown == pytest.approx(-1.0)
