"""Both plans of every per-group operator give the same rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidefolio.operators import groups as g
from tidefolio.operators.crosssection import winsorise


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    rows = [
        # one date holds a third of the rows, and values repeat often
        ("d1" if i % 3 == 0 else f"d{i % 7}", f"c{i:03d}", float(rng.randint(0, 12)) if i % 11 else None)
        for i in range(240)
    ]
    return spark.createDataFrame(rows, "date string, code string, v double").repartition(5)


def _pd(df, by=("date", "code")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def _same(a, b, by=("date", "code")):
    x, y = _pd(a, by), _pd(b, by)
    cols = sorted(x.columns)
    pd.testing.assert_frame_equal(x[cols], y[cols], check_dtype=False, rtol=1e-12)


@pytest.fixture
def gaps(spark):
    """NULL keys, NULL values, groups without a known value, and values that start with NULLs."""
    rows = [(d, f"c{i}", v) for d in ("d1", None) for i, v in enumerate([None, None, 2.0, 1.0, 2.0, None, 5.0])]
    rows += [("d2", "c0", None), ("d2", "c1", None), ("d3", "c0", 4.0)]
    return spark.createDataFrame(rows, "date string, code string, v double").repartition(3)


def _plans(spark, call):
    spark.conf.set(g.LIMIT_KEY, "3")
    split = [call(None), call(7)]
    rows = [[tuple(r) for r in df.collect()] for df in split]
    spark.conf.unset(g.LIMIT_KEY)
    rows.append([tuple(r) for r in call(7).collect()])
    return [sorted(r, key=repr) for r in rows]


CALLS = {
    "aggregates": lambda df, n: g.with_aggregates(df, ["date"], {"s": F.sum("v"), "n": F.count("v")}, n),
    "running_sums": lambda df, n: g.running_sums(df, ["date"], [F.col("code")], {"r": F.col("v")}, n),
    "row_numbers": lambda df, n: g.row_numbers(df, ["date"], [F.col("v").desc(), F.col("code")], "rn", n),
    "average_ranks": lambda df, n: g.average_ranks(df, ["date"], {"r": "v"}, n),
    "quantiles": lambda df, n: g.quantiles(df, ["date"], "v", {"lo": 0.1, "mid": 0.5}, n),
    "median": lambda df, n: g.with_median(df, ["date"], "v", "mid", n),
    "winsorise": lambda df, n: winsorise(df, "v", "w", 0.1, max_rows=n),
}


@pytest.mark.parametrize("name", CALLS)
def test_plans_agree_on_nulls(spark, gaps, name):
    none, split, window = _plans(spark, lambda n: CALLS[name](gaps, n))
    assert none == split == window and window


def test_null_rules(spark, gaps):
    ranks = {(r["date"], r["code"]): r["r"] for r in g.average_ranks(gaps, ["date"], {"r": "v"}, 7).collect()}
    assert [ranks[(None, f"c{i}")] for i in range(7)] == [None, None, 2.5, 1.0, 2.5, None, 4.0]
    sums = {(r["date"], r["code"]): r["r"] for r in CALLS["running_sums"](gaps, None).collect()}
    assert [sums[(None, f"c{i}")] for i in range(7)] == [None, None, 2.0, 3.0, 5.0, 5.0, 10.0]


def test_nothing_is_counted_without_a_bound(spark, gaps):
    assert not g.fits_one_task(gaps, None) and g.fits_one_task(gaps, 7)


def test_aggregates(frame, split):
    aggs = {"s": F.sum("v"), "m": F.avg("v"), "n": F.count("v")}
    _same(g.with_aggregates(frame, ["date"], aggs, 240), g.with_aggregates(frame, ["date"], aggs, 1))


def test_row_numbers(frame, split):
    order = [F.col("v").desc(), F.col("code")]
    wide = g.row_numbers(frame, ["date"], order, "rn")
    _same(wide, g.row_numbers(frame, ["date"], order, "rn", 1))


def test_running_sums(frame, split):
    sums = {"r": F.col("v"), "one": F.lit(1).cast("long")}
    rows = frame.where(F.col("v").isNotNull())
    a = g.running_sums(rows, ["date"], [F.col("code")], sums)
    _same(a, g.running_sums(rows, ["date"], [F.col("code")], sums, 1))
    pdf = rows.toPandas().sort_values("code")
    want = pdf.assign(r=pdf.groupby("date")["v"].cumsum())[["date", "code", "r"]]
    pd.testing.assert_frame_equal(
        _pd(a.select("date", "code", "r")), want.sort_values(["date", "code"]).reset_index(drop=True)
    )


def test_average_ranks(frame, split):
    rows = frame.where(F.col("v").isNotNull())
    a = g.average_ranks(rows, ["date"], {"r": "v"})
    _same(a, g.average_ranks(rows, ["date"], {"r": "v"}, 1))
    pdf = _pd(rows)
    want = pdf.groupby("date")["v"].rank(method="average")
    assert np.allclose(_pd(a)["r"], want)


@pytest.mark.parametrize("rows_bound", [None, 1])
def test_quantiles_and_median(frame, split, rows_bound):
    probs = {"q0": 0.0, "q01": 0.01, "q5": 0.5, "q99": 0.99, "q1": 1.0}
    got = _pd(g.quantiles(frame, ["date"], "v", probs, rows_bound), ["date"])
    pdf = frame.toPandas().dropna()
    for name, p in probs.items():
        want = pdf.groupby("date")["v"].quantile(p).sort_index()
        assert np.allclose(got[name], want)
    mids = g.with_median(frame, ["date"], "v", "mid", rows_bound).toPandas().groupby("date")["mid"].first()
    assert np.allclose(mids, pdf.groupby("date")["v"].median())


def test_top_rows(frame):
    got = _pd(g.top_rows(frame, ["date"], [F.col("v").desc_nulls_last(), F.col("code")], 4))
    pdf = frame.toPandas().sort_values(["date", "v", "code"], ascending=[True, False, True], na_position="last")
    want = pdf.groupby("date").head(4).sort_values(["date", "code"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize(
    "name", ["benchmark_weights", "quantile_groups", "optimal_weights", "impact_cost", "cross_section_quantiles", "rank_ic_and_spread", "prepared_alpha"]
)
def test_queries_with_split_groups(spark, split, name):
    """Whole queries still match their SQL when no group fits one task."""
    from check_oracle import connect, run

    from tidefolio.catalog import oracle_sql, queries

    sf = "/root/testdata/sf0.001"
    _, _, diff = run(spark, connect(sf), sf, name, queries()[name], oracle_sql()[name])
    assert diff == ""
