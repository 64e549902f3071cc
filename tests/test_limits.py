"""Industry limits against nested bisection, portfolio limits against their conditions of optimality."""

from datetime import date

import numpy as np
import pytest

from tidefolio.operators import allocate as al, limits as lm

D = date(2024, 1, 2)
SCHEMA = (
    "scenario_id string, date date, code string, industry string, is_constituent boolean, alpha double, ref double, gamma double, "
    "kappa double, prev_weight double, lb double, ub double"
)
LIMITS = "scenario_id string, date date, kind string, key string, lo double, hi double"


def names(rng, scenario, n=60, cap=0.1):
    prev, ref = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n))
    out = []
    for i in range(n):
        ub = 0.0 if i % 11 == 0 else cap
        out.append((scenario, D, f"c{i:03d}", f"i{i % 5}" if i % 17 else None, i % 3 == 0, float(rng.normal()), float(ref[i]), 6.0, float(rng.uniform(0, 0.2)), float(prev[i]), 0.0, ub))
    return out


def best(r, nu):
    u, t = r[6] + (r[5] - nu) / (2 * r[7]), r[8] / (2 * r[7])
    u = u - t if u > r[9] + t else u + t if u < r[9] - t else r[9]
    return min(max(u, r[10]), r[11])


def falling_root(f, level):
    a, b = -200.0, 200.0
    for _ in range(200):
        mid = (a + b) / 2
        a, b = (mid, b) if f(mid) > level else (a, mid)
    return b


def nested(rows, bounds):
    """Weights by bisection of the budget price over industries cut off at their limits."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)

    def total(rs, nu):
        return sum(best(r, nu) for r in rs)

    def cut(g, nu):
        lo, hi = bounds.get(g, (-9.0, 9.0))
        return min(max(total(groups[g], nu), lo), hi)

    nu = falling_root(lambda x: sum(cut(g, x) for g in groups), 1.0)
    out = {}
    for g, rs in groups.items():
        own = nu
        if abs(cut(g, nu) - total(rs, nu)) > 1e-9:
            own = falling_root(lambda x: total(rs, x), cut(g, nu))
        out |= {r[2]: best(r, own) for r in rs}
    return out


@pytest.fixture(params=[None, 1000])
def max_rows(request):
    return request.param


def test_industry_limits_by_bisection(spark, max_rows):
    rng = np.random.default_rng(5)
    rows, limits, bounds = [], [], {}
    for k in range(4):
        mine = names(rng, f"s{k}")
        free = nested(mine, {})
        bounds[f"s{k}"] = {}
        for j in range(4):
            held = sum(free[r[2]] for r in mine if r[3] == f"i{j}")
            lo, hi = [(None, held * 0.7), (held * 1.3, None), (held, held), (0.0, 1.0)][j]
            bounds[f"s{k}"][f"i{j}"] = (-9.0 if lo is None else lo, 9.0 if hi is None else hi)
            limits.append((f"s{k}", D, "industry", f"i{j}", lo, hi))
        limits.append((f"s{k}", D, "industry", None, 0.05, 0.06))  # names without an industry are one
        bounds[f"s{k}"][None] = (0.05, 0.06)
        rows += mine
    got = lm.allocate_industries(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(limits, LIMITS), max_rows=max_rows).collect()
    assert len(got) == len(rows) and {r.status_code for r in got} == {al.OPTIMAL}
    for k in range(4):
        want = nested([r for r in rows if r[0] == f"s{k}"], bounds[f"s{k}"])
        for r in got:
            if r.scenario_id == f"s{k}":
                assert r.weight == pytest.approx(want[r.code], abs=1e-9)


def test_without_limits_as_allocate(spark):
    rows = spark.createDataFrame(names(np.random.default_rng(6), "s"), SCHEMA)
    none = spark.createDataFrame([], LIMITS)
    want = {r.code: r.weight for r in al.allocate(rows).collect()}
    for got in (lm.allocate_industries(rows, none), lm.allocate_limited(rows, none, rounds=1)):
        assert {r.code: r.weight for r in got.collect()} == {c: pytest.approx(w, abs=1e-9) for c, w in want.items()}


def test_contradictions_are_proved(spark):
    rng = np.random.default_rng(7)
    rows, limits = [], []
    cases = {
        "sum_low": [("industry", f"i{j}", 0.3, None) for j in range(4)],
        "sum_high": [("industry", f"i{j}", None, 0.1) for j in range(5)] + [("industry", None, None, 0.1)],
        "beyond_names": [("industry", "i1", 0.99, None), ("industry", "i2", 0.9, None)],
        "members": [("constituent", "members", 1.5, None)],
        "turnover": [("turnover", "two_way", None, 1e-5)],
        "ball": [("deviation", "l2", None, 1e-5)],
        "fine": [("constituent", "members", 0.2, None)],
    }
    for name, held in cases.items():
        rows += names(rng, name)
        limits += [(name, D, *h) for h in held]
    got = lm.allocate_limited(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(limits, LIMITS), rounds=2, max_rows=1000)
    assert {r.scenario_id: r.status_code for r in got.select("scenario_id", "status_code").distinct().collect()} == {
        name: al.OPTIMAL if name == "fine" else al.INFEASIBLE for name in cases
    }


def test_portfolio_limits_hold_and_are_optimal(spark):
    """At its price the portfolio is the best one of the priced problem and meets the limit with equality."""
    rng = np.random.default_rng(8)
    rows, limits = [], []
    wanted = {"members": ("constituent", 0.8, None), "turnover": ("turnover", None, 0.9), "ball": ("deviation", None, 0.2), "idle": ("turnover", None, 2.5)}
    for name, (kind, lo, hi) in wanted.items():
        rows += names(rng, name)
        limits += [(name, D, kind, "x", lo, hi), (name, D, "industry", "i1", None, 0.15)]
    got = lm.allocate_limited(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(limits, LIMITS), max_rows=1000).collect()
    for name, (kind, lo, hi) in wanted.items():
        mine = {r.code: r for r in got if r.scenario_id == name}
        w = {c: r.weight for c, r in mine.items()}
        assert {r.status_code for r in mine.values()} == {al.OPTIMAL} and sum(w.values()) == pytest.approx(1)
        value = {
            "constituent": sum(x for c, x in w.items() if mine[c].is_constituent),
            "turnover": sum(abs(x - mine[c].prev_weight) for c, x in w.items()),
            "deviation": sum((x - mine[c].ref) ** 2 for c, x in w.items()) ** 0.5,
        }[kind]
        price = next(iter(mine.values())).limit_price
        if name == "idle":
            assert price == 0 and value < hi
        else:
            assert price > 0 and value == pytest.approx(hi if lo is None else lo, abs=1e-6)
        priced = []
        for r in (r for r in rows if r[0] == name):
            r = list(r)
            r[5] += price if kind == "constituent" and r[4] else 0
            r[8] += price if kind == "turnover" else 0
            r[7] *= 2**price if kind == "deviation" else 1
            priced.append(tuple(r))
        want = nested(priced, {"i1": (-9.0, 0.15)})
        assert w == {c: pytest.approx(x, abs=1e-7) for c, x in want.items()}


def test_a_price_is_found_in_few_trials(spark, monkeypatch):
    """Every trial is a copy of the group's names, so their number is what a search costs."""
    rng = np.random.default_rng(9)
    rows, limits = [], []
    for name, kind, lo, hi in (("members", "constituent", 0.8, None), ("turnover", "turnover", None, 0.9), ("ball", "deviation", None, 0.2)):
        rows += names(rng, name)
        limits += [(name, D, kind, "x", lo, hi), (name, D, "industry", "i1", None, 0.15)]
    tried, written = [], lm.cut_lineage

    def counted(df, *args):
        out = written(df, *args)
        if {"_j", "alpha", "lb"} <= set(out.columns):
            tried.append(out.count())
        return out

    monkeypatch.setattr(lm, "cut_lineage", counted)
    got = lm.allocate_limited(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(limits, LIMITS), max_rows=1000).collect()
    assert len(got) == len(rows) and all(r.status_code == al.OPTIMAL and r.limit_price > 0 for r in got)
    assert 0 < sum(tried) < 32 * len(rows)
