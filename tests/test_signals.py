"""Signal measures against pandas on small random panels."""

import re
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidefolio.operators import signals as sg, timeseries as ts
from tidefolio.operators.calendar import asof_dates, trading_calendar
from tidefolio.plans.signal_grid import run_grid

N, T = 30, 40


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(11)
    wide = pd.DataFrame(
        10 * np.exp(np.cumsum(rng.normal(0, 0.02, (T, N)), axis=0)),
        index=[date(2024, 1, 1) + timedelta(i) for i in range(T)],
        columns=[f"c{i:02d}" for i in range(N)],
    )
    return wide.mask(rng.random((T, N)) < 0.05)


@pytest.fixture(scope="module")
def panel(spark, prices):
    long = prices.stack().rename("adj_close").rename_axis(["date", "code"]).reset_index()
    return spark.createDataFrame(long, "date date, code string, adj_close double")


def test_forward_returns_follow_the_panel_calendar(panel, prices):
    got = ts.forward_returns(panel, trading_calendar(panel), 3).toPandas()
    want = prices.shift(-3) / prices - 1
    for r in got.itertuples():
        w = want.loc[r.date, r.code]
        assert (pd.isna(r.fwd_ret) and pd.isna(w)) or r.fwd_ret == pytest.approx(w)


def test_evaluation_against_pandas(spark, panel, prices):
    days = trading_calendar(panel)
    rng = np.random.default_rng(2)
    f = pd.DataFrame(rng.integers(0, 15, prices.shape).astype(float), index=prices.index, columns=prices.columns)
    signal = spark.createDataFrame(
        f.stack().rename("f").rename_axis(["date", "code"]).reset_index(), "date date, code string, f double"
    )
    fwd = prices.shift(-2) / prices - 1
    valid = fwd.index[fwd.notna().sum(axis=1) > 20]
    dates = sg.evaluation_dates(panel, days, 2, 4, 20)
    assert sorted(r[0] for r in dates.collect()) == list(valid[::4])
    forward = sg.standard_forward_returns(panel, days, 2, 20)
    rows = sg.measured_rows(signal, forward, dates, q=0.2, min_names=20)
    ics = {r.date: r for r in sg.information_coefficients(rows).collect()}
    moves = {r.date: r for r in sg.persistence(rows).collect()}
    before = None
    for d in valid[::4]:
        r = fwd.loc[d].dropna()
        a = f.loc[d, r.index]
        assert ics[d].ic == pytest.approx(a.rank().corr(r.rank()))
        k = max(int(len(a) * 0.2), 1)
        top, bottom = a.nlargest(k).index, a.nsmallest(k).index
        assert ics[d].long_short == pytest.approx(r[top].mean() - r[bottom].mean())
        if before is not None:
            pa, ptop = before
            common = a.index.intersection(pa.index)
            assert moves[d].autocorr == pytest.approx(a[common].rank().corr(pa[common].rank()))
            assert moves[d].turnover == pytest.approx(1 - len(set(top) & set(ptop)) / k)
        else:
            assert d not in moves
        before = (a, top)


def test_smoothing_restarts_after_a_gap(spark):
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("a", 3, 5.0), ("a", 4, 1.0), ("b", 2, 7.0)]
    df = spark.createDataFrame(rows, "code string, day int, s double").withColumn("decay", F.lit(0.6))
    got = {(r.code, r.day): r.f for r in ts.smooth(df).collect()}
    assert got == pytest.approx({("a", 0): 1.0, ("a", 1): 0.6 + 0.8 * 2, ("a", 3): 5.0, ("a", 4): 3.0 + 0.8, ("b", 2): 7.0})


def test_asof_needs_a_date_not_after(spark):
    d = [date(2024, 1, i) for i in range(1, 8)]
    want = spark.createDataFrame([(x,) for x in (d[0], d[2], d[4])], "date date")
    have = spark.createDataFrame([(x,) for x in (d[1], d[2], d[5])], "date date")
    got = {r.date: r.near for r in asof_dates(want, have, "near").collect()}
    assert got == {d[0]: None, d[2]: d[2], d[4]: d[2]}


def test_default_grid_has_28_distinct_points():
    points = sg.grid_points()
    assert len(points) == 29 and len(sg.distinct_points(points)) == 28


def test_stronger_signals_measure_stronger(panel):
    points = sg.grid_points(ics=(0.05, 0.6), icirs=(10.0,), decays=(0.0,), ic=0.3, icir=10.0)
    out = run_grid(panel, trading_calendar(panel), points, (1, 2), fwd_days=2, every=2, min_names=20).toPandas()
    assert list(out.columns) == [
        "sweep", "in_ic", "in_ic_std", "in_icir", "in_decay", "ic", "ic_std", "icir", "ir_theory", "ls_ir", "ls_ann", "autocorr", "turnover", "n_seeds",
    ]
    by = out.set_index("in_ic")
    assert by.loc[0.6, "ls_ann"] > by.loc[0.3, "ls_ann"] > 0
    assert (by["n_seeds"] == 2).all() and set(by["sweep"]) == {"ic_icir", "decay"}


def test_smoothing_over_several_blocks(spark):
    """Runs longer than a block, with a gap, a NULL and two decays, against a plain loop."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for code, decay in (("a", 0.9), ("b", 0.0), ("c", 0.97)):
        f = None
        for day in range(200):
            if code == "a" and day == 150:
                f = None
                continue
            s = None if code == "c" and day == 140 else float(rng.normal())
            if f is None:
                f = s
            else:
                f = None if s is None else decay * f + (1 - decay * decay) ** 0.5 * s
            if code == "c" and day > 140:
                f = None
            rows.append((code, day, decay, s))
            want[(code, day)] = f
            if f is None and not (code == "c" and day >= 140):
                raise AssertionError
    df = spark.createDataFrame(rows, "code string, day int, decay double, s double")
    got = {(r.code, r.day): r.f for r in ts.smooth(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_grid_points_from_a_table(spark):
    df = spark.range(3)
    points = [(0.05, 0.1, 0.0), (0.08, 0.1, 0.8)]
    table = spark.createDataFrame(points, "in_ic double, in_ic_std double, decay double")
    cols = ["id", "in_ic", "in_ic_std", "decay"]
    one, two = (sg.with_points(df, p).select(*cols).collect() for p in (points, table))
    assert sorted(one) == sorted(two) and len(one) == 6


def test_points_equal_after_rounding_are_measured_once(panel):
    points = [("a", 0.05, 0.1, 0.5), ("b", 0.05 + 1e-9, 0.1, 0.5), ("a", 0.05, 0.1 - 1e-9, 0.5)]
    rows = run_grid(panel, trading_calendar(panel), points, (7,), fwd_days=2, every=3, min_names=20).collect()
    assert sorted(r["sweep"] for r in rows) == ["a", "b"] and len({(r["in_ic"], r["in_ic_std"], r["ic"]) for r in rows}) == 1


@pytest.mark.parametrize("max_rows", [N, None])
def test_grid_measures_what_the_operators_do_without_dealing_the_points(panel, max_rows):
    """Against calibration signals measured step by step; before the rows of all points there is one exchange, of the series."""
    from tidefolio.plans import signal_grid

    days, points, seeds = trading_calendar(panel), [(0.3, 0.1, 0.0), (0.1, 0.2, 0.8)], (5, 6)
    forward, dates = sg.standard_forward_returns(panel, days, 2, 20), sg.evaluation_dates(panel, days, 2, 3, 20)
    keys = ["in_ic", "in_ic_std", "decay", "seed"]
    rows = sg.measured_rows(sg.calibration_signals(forward, days, points, seeds), forward, dates, keys, min_names=20)
    stats = sg.signal_statistics(sg.information_coefficients(rows, keys), sg.persistence(rows, keys), keys, 2).toPandas()
    want = stats.groupby(keys[:3])[signal_grid.STATS].mean()
    got = signal_grid.measure_points(panel, days, points, seeds, 2, 3, 20, max_rows=max_rows).toPandas().set_index(keys[:3])[signal_grid.STATS]
    assert len(got) == 2 and np.allclose(got.loc[want.index].to_numpy(float), want.to_numpy(float), atol=1e-9)
    if max_rows:
        stored, cells = signal_grid.cut_lineage(forward), signal_grid._coefficients(forward, days, points, seeds)
        places = signal_grid.cut_lineage(dates.withColumn("place", F.lit(1)))
        plan = signal_grid._point_rows(stored, signal_grid.cut_lineage(days), places, cells, seeds)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_grid_deals_sections_in_parts_and_not_name_by_name(spark, panel, monkeypatch):
    """No window or exploded row per name of a cell; any size of the parts and batches gives the same figures."""
    from tidefolio.plans import signal_grid

    days, points, plans, cut = trading_calendar(panel), [(0.3, 0.1, 0.0), (0.1, 0.2, 0.8), (0.05, 0.1, 0.95)], [], signal_grid.cut_lineage

    def noted(df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *by)

    def measured():
        out = signal_grid.measure_points(panel, days, points, (5, 6), 2, 3, 20, max_rows=N).toPandas()
        return out.sort_values(["in_ic", "decay"]).to_numpy(float)

    monkeypatch.setattr(signal_grid, "cut_lineage", noted)
    whole = measured()
    assert len(whole) == 3 and not np.isnan(whole).any()
    assert not [p for p in plans if "posexplode" in p or re.search(r"Window \[.*cell#\d+, place#\d+", p)]
    monkeypatch.setattr(signal_grid, "HELD", 50)  # parts of a code or two
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert np.allclose(measured(), whole, rtol=0, atol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_section_with_ties_against_pandas():
    from tidefolio.plans.signal_grid import _ranks, _section

    rng = np.random.default_rng(3)
    f0, f, ahead = (rng.integers(0, 6, n).astype(float) for n in (40, 37, 37))
    codes0, codes = (np.sort(rng.permutation(60)[:n]) for n in (40, 37))
    at = np.array([int(np.flatnonzero(codes0 == c)[0]) if c in codes0 else -1 for c in codes])
    ranks = _ranks(ahead, np.argsort(ahead))[0]
    _, was = _section(f0, f0, _ranks(f0, np.argsort(f0))[0], 0.2, np.full(40, -1), None)
    (ic, spread, auto, turnover), _ = _section(f, ahead, ranks, 0.2, at, was)
    now = pd.DataFrame({"f": f, "fwd": ahead}, index=codes).rename_axis("code").reset_index()
    before = pd.DataFrame({"f": f0, "code": codes0})
    ends = [x.sort_values(["f", "code"], ascending=[up, True]).head(k) for x, up, k in ((now, False, 7), (now, True, 7), (before, False, 8))]
    both = now.merge(before, on="code")
    assert ic == pytest.approx(now["f"].rank().corr(now["fwd"].rank()))
    assert spread == pytest.approx(ends[0]["fwd"].mean() - ends[1]["fwd"].mean())
    assert len(both) > 10 and auto == pytest.approx(both["f_x"].rank().corr(both["f_y"].rank()))
    assert turnover == pytest.approx(1 - len(set(ends[0]["code"]) & set(ends[2]["code"])) / 7)


def test_a_grid_without_valid_dates_is_empty(panel):
    assert run_grid(panel, trading_calendar(panel), [("a", 0.05, 0.1, 0.5)], (7,), fwd_days=2, every=3, min_names=N + 1, max_rows=N).collect() == []


def test_both_plans_of_the_grid_agree_on_nan(panel):
    """NaN is the largest value, also where the place before is asked whether a code was in its top group."""
    from tidefolio.plans import signal_grid

    odd = panel.withColumn("adj_close", F.when((F.col("code") == "c05") & (F.col("date") == date(2024, 1, 20)), F.lit(float("nan"))).otherwise(F.col("adj_close")))
    days, points = trading_calendar(odd), [(0.3, 0.1, 0.0), (0.1, 0.2, 0.8)]
    got = [signal_grid.measure_points(odd, days, points, (5,), 2, 3, 20, max_rows=n).toPandas().sort_values("in_ic").to_numpy(float) for n in (N, None)]
    assert len(got[0]) == 2 and np.allclose(*got, atol=1e-9, equal_nan=True)
