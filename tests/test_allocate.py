"""Weights against bisection, their invariants, and group limits."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefolio.operators import allocate as al, audit as au, bounds as bd, coupled as cp

D = date(2024, 1, 2)
SCHEMA = "scenario_id string, date date, code string, alpha double, ref double, gamma double, kappa double, prev_weight double, lb double, ub double"


def _group(rng, name, n, sticky, cap):
    prev = rng.dirichlet(np.ones(n)) if sticky else [None] * n
    rows = []
    for i in range(n):
        kind = rng.integers(0, 10)
        p = prev[i]
        lb, ub = 0.0, cap
        if kind == 0:
            ub = 0.0
        elif kind == 1 and sticky:
            ub = min(cap, p)
        elif kind == 2 and sticky and p < cap:
            lb = p
        rows.append((name, D, f"c{i:03d}", float(rng.normal()), float(rng.uniform(0, 2 / n)), 5.0, float(rng.uniform(0, 0.3)), None if p is None else float(p), float(lb), float(ub)))
    return rows


def _best(r, nu):
    two = 2 * r.gamma
    u = r.ref + (r.alpha - nu) / two
    if r.prev_weight is not None and not np.isnan(r.prev_weight):
        t = r.kappa / two
        u = u - t if u > r.prev_weight + t else u + t if u < r.prev_weight - t else r.prev_weight
    return min(max(u, r.lb), r.ub)


def _bisect(rows):
    lo, hi = -100.0, 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(_best(r, mid) for r in rows) > 1:
            lo = mid
        else:
            hi = mid
    return {r.code: _best(r, hi) for r in rows}


def test_weights_equal_bisection(spark):
    rng = np.random.default_rng(3)
    rows = [r for k in range(6) for r in _group(rng, f"s{k}", 60 + 10 * k, k % 2 == 0, 0.08)]
    names = spark.createDataFrame(rows, SCHEMA)
    got = al.allocate(names).collect()
    for k in range(6):
        mine = [r for r in got if r.scenario_id == f"s{k}"]
        assert {r.status_code for r in mine} == {al.OPTIMAL}
        want = _bisect(mine)
        assert sum(r.weight for r in mine) == pytest.approx(1, abs=1e-9)
        assert max(abs(r.weight - want[r.code]) for r in mine) < 1e-9
        assert all(r.lb - 1e-9 <= r.weight <= r.ub + 1e-9 for r in mine)


def test_split_groups_give_the_same_weights(spark, split):
    rng = np.random.default_rng(4)
    names = spark.createDataFrame(_group(rng, "s", 80, True, 0.1), SCHEMA)
    whole = {r.code: r.weight for r in al.allocate(names, max_rows=0).collect()}
    parts = {r.code: r.weight for r in al.allocate(names, max_rows=100).collect()}
    assert parts == pytest.approx(whole, abs=1e-12)


def test_infeasible_groups_are_told(spark):
    def rows(name, lb, ub):
        return [(name, D, f"c{i}", 0.1 * i, 0.0, 1.0, 0.0, None, lb, ub) for i in range(4)]

    names = spark.createDataFrame(rows("low", 0.3, 0.4) + rows("high", 0.0, 0.2) + rows("crossed", 0.5, 0.4) + rows("edge", 0.0, 0.25), SCHEMA)
    got = {r.scenario_id: (r.status_code, r.w) for r in al.allocate(names).groupBy("scenario_id", "status_code").agg(F.sum("weight").alias("w")).collect()}
    assert got["low"] == got["high"] == got["crossed"] == (al.INFEASIBLE, 0.0)
    assert got["edge"] == (al.OPTIMAL, pytest.approx(1.0))


def test_name_bounds_rules(spark):
    rows = [("normal", 0.1), ("suspended", 0.1), ("new_listing", 0.1), ("limit_up", 0.02), ("limit_up", 0.3), ("limit_down", 0.03), ("limit_up", None), ("limit_down", None)]
    df = spark.createDataFrame(rows, "status string, prev_weight double").withColumn("weight_upper", F.lit(0.05))
    got = [(r.lb, r.ub) for r in bd.name_bounds(df).collect()]
    assert got == [(0, 0.05), (0, 0), (0, 0), (0, 0.02), (0, 0.05), (0.03, 0.05), (0, 0.05), (0, 0.05)]


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(7)
    n = 120
    names = [
        (D, f"c{i:03d}", "suspended" if i % 31 == 0 else "normal", f"I{i % 10}", i % 3 != 0, float(rng.normal()), 1.0 / n, None, 1.0)
        for i in range(n)
    ]
    expo = [(D, f"c{i:03d}", f, float(rng.normal() + (0.8 if f == "Size" else 0))) for i in range(n) for f in ("Size", "Beta", "Value")]
    return (
        spark.createDataFrame(names, "date date, code string, status string, industry string, is_constituent boolean, alpha double, bm_weight double, prev_weight double, cost double"),
        spark.createDataFrame(expo, "date date, code string, factor string, x double"),
    )


def test_group_limits_hold_after_pricing(spark, market):
    names, exposures = market
    scenarios = [
        bd.scenario("enhanced", "index_enhance", weight_upper=0.05, style_bound={"default": 0.3, "Size": 0.05}, industry_active_bound=0.05),
        bd.scenario("long", "alpha_max", weight_upper=0.05, penalty=5.0, industry_upper=0.15, style_bound=0.2),
    ]
    inputs = al.allocation_inputs(bd.tradable_alpha(bd.name_bounds(bd.with_scenarios(names, scenarios))))
    limits = bd.group_bounds(inputs, exposures)
    free = au.audit(al.allocate(inputs), limits, exposures)
    assert free.agg(F.max("violation")).first()[0] > 0.05
    weights = cp.allocate_coupled(inputs, limits, exposures, rounds=60, tolerance=1e-4)
    rows = au.audit(weights, limits, exposures).collect()
    assert max(r.violation for r in rows) < 5e-3
    by_kind = {(r.scenario_id, r.kind): r.value for r in rows}
    for s in ("enhanced", "long"):
        assert by_kind[(s, "budget")] == pytest.approx(1, abs=1e-5)
        assert by_kind[(s, "names")] < 1e-6 and by_kind[(s, "banned")] == 0


def test_groups_that_still_break_a_limit_are_not_called_optimal(spark, market):
    names, exposures = market
    scenarios = [
        bd.scenario("impossible", "alpha_max", weight_upper=0.05, penalty=5.0, industry_upper=0.05, style_bound=None),
        bd.scenario("easy", "alpha_max", weight_upper=0.05, penalty=5.0, industry_upper=1.0, style_bound=None),
    ]
    inputs = al.allocation_inputs(bd.tradable_alpha(bd.name_bounds(bd.with_scenarios(names, scenarios))))
    limits = bd.group_bounds(inputs)
    got = cp.allocate_coupled(inputs, limits, rounds=3).select("scenario_id", "status_code").distinct().collect()
    assert {tuple(r) for r in got} == {("impossible", cp.NOT_CONVERGED), ("easy", al.OPTIMAL)}


def test_defaults_and_unweighted_cost(spark, market):
    names, _ = market
    plain = bd.scenario("long", "alpha_max")
    assert (plain["weight_upper"], plain["industry_upper"], plain["style_bound"]) == (0.02, 0.20, 1.0)
    scenarios = [bd.scenario(s, "alpha_max", turnover_penalty=0.1, liquidity_weighted_cost=s == "w") for s in ("w", "u")]
    rows = al.allocation_inputs(bd.with_scenarios(names.withColumn("cost", F.lit(3.0)), scenarios))
    got = {tuple(r) for r in rows.select("scenario_id", F.round("kappa", 9)).distinct().collect()}
    assert got == {("w", 0.3), ("u", 0.1)}


def test_a_failed_date_keeps_the_last_weights_and_a_failed_start_has_none(spark):
    from tidefolio.plans.rebalance import _run_carried

    days = [date(2024, 1, d) for d in (2, 3, 4, 5)]
    rows = [(s, d, c, None) for s in ("s", "t") for d in days for c in ("a", "b")]
    spread = spark.createDataFrame(rows, "scenario_id string, date date, code string, prev_weight double")
    seen = []

    def solve(today):
        seen.append({(r.scenario_id, r.code): r.prev_weight for r in today.collect()})
        fails = (F.col("scenario_id") == "s") & F.col("date").isin(days[0], days[2])
        weight = F.when(F.col("code") == "a", 0.75).otherwise(0.25)
        return today.withColumns(
            {"weight": F.when(fails, 0.0).otherwise(weight), "status_code": F.when(fails, "infeasible").otherwise(al.OPTIMAL)}
        )

    weights, statuses = _run_carried(spread, spread, solve, 10)
    got = {(r.scenario_id, r.date, r.code): r.weight for r in weights.collect()}
    want = {("t", d, c): w for d in days for c, w in (("a", 0.75), ("b", 0.25))}
    want |= {("s", d, c): w for d in days[1:] for c, w in (("a", 0.75), ("b", 0.25))}
    assert got == want
    assert {tuple(r) for r in statuses.where("scenario_id = 's'").collect()} == {
        ("s", d, "infeasible" if d in (days[0], days[2]) else al.OPTIMAL) for d in days
    }
    assert seen[1][("s", "a")] is None and seen[2][("s", "a")] == 0.75 and seen[3][("s", "a")] == 0.75


def test_scenarios_from_a_table(spark, market):
    names, _ = market
    given = [bd.scenario("a", "alpha_max", style_bound={"Size": 0.4}), bd.scenario("b", "index_enhance", style_bound=None)]
    cols = ["scenario_id", "strategy", *bd.NUMBERS]
    rows = [
        (*[s[c] if c in ("scenario_id", "strategy") else None if s.get(c) is None else float(s[c]) for c in cols], s["style_bound"])
        for s in given
    ]
    types = ["string", "string"] + ["double"] * len(bd.NUMBERS)
    table = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(cols, types)) + ", style_bounds map<string,double>")
    one, two = bd.with_scenarios(names, given), bd.with_scenarios(names, table)
    assert one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    many = spark.range(1000).selectExpr("concat('s', id) AS scenario_id", "'alpha_max' AS strategy", "0.1D AS weight_upper")
    wide = bd.with_scenarios(names, many)
    few = bd.with_scenarios(names, many.where("scenario_id < 's3'"))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(wide) - size(few)) < 1000 and wide.count() == 1000 * names.count()


def test_scenarios_reject_unknown_parameters():
    with pytest.raises(ValueError):
        bd.scenario("x", "other")
    with pytest.raises(ValueError):
        bd.scenario("x", "alpha_max", colour=1.0)


def test_carry_and_turnover(spark):
    last = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.3), ("s", "gone", 0.2)], "scenario_id string, code string, weight double")
    now = spark.createDataFrame([("s", D, "a"), ("s", D, "b"), ("s", D, "new"), ("t", D, "a")], "scenario_id string, date date, code string")
    got = {(r.scenario_id, r.code): r.prev_weight for r in al.carry_weights(now, last).collect()}
    assert got == {("s", "a"): pytest.approx(0.625), ("s", "b"): pytest.approx(0.375), ("s", "new"): 0.0, ("t", "a"): None}
    d2, d3 = date(2024, 1, 9), date(2024, 1, 16)
    w = spark.createDataFrame(
        [("s", D, "a", 0.6), ("s", D, "b", 0.4), ("s", d2, "a", 0.5), ("s", d2, "c", 0.5), ("s", d3, "a", 0.5), ("s", d3, "c", 0.5)],
        "scenario_id string, date date, code string, weight double",
    )
    turn = {r.date: r.turnover for r in au.turnover(w).collect()}
    assert turn == {D: None, d2: pytest.approx(1.0), d3: pytest.approx(0.0)}
