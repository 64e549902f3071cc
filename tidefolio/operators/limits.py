"""Weights under limits on groups, read off an index of breakpoints.

Industries are disjoint, so their limits need no rounds: each industry's total
is a falling function of its price in straight pieces; cut off at its limits it
stays one, and the sum of the cut functions gives the budget price. An industry
at a limit takes the price of that limit instead. The result is exact, and a
group whose limits cannot hold together is known from sums of bounds alone.

One more limit on the whole portfolio (members, turnover, or the distance to
the reference) has one price, and the sum it limits is monotone in it. Zero is
tried first and the price beyond which nothing moves any more second: if even
that breaks the limit, it cannot be met. Between the two, rounds of a few
prices, all tried in one job, narrow the bracket: about the price where a line
through its ends meets the limit, and its middle, so that it halves at least.
A group leaves the rounds once its value is known to the tolerance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidefolio.operators.allocate import INFEASIBLE, KEYS, OPTIMAL, before, price_of_level, price_steps, running_steps, weight_at
from tidefolio.operators.groups import join_groups
from tidefolio.session import cut_lineage

NOT_CONVERGED = "not_converged"
WHOLE = ("constituent", "turnover", "deviation")  # limits on the whole portfolio, in the order they are searched
DOUBLINGS = 40.0  # of gamma, beyond which a portfolio no longer gets closer to its reference
FIRST = (1 / 256, 1 / 64, 1 / 16, 1 / 4, 1.0)  # shares of the whole span that the first round tries
NEAR = 1 / 16  # share of the bracket that later rounds go to either side of the line's price, less as its misses shrink
CARE = 4.0  # how much wider than the miss that is expected
LEAST = 2.0**-20
ROUNDS = 24  # halvings of the bracket at worst
TOLERANCE = 1e-6
#: what a weight and the sums over a portfolio depend on
PRICED = ("industry", "is_constituent", "alpha", "ref", "gamma", "kappa", "prev_weight", "lb", "ub")


def industry_sides(names: DataFrame, limits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, industry, lo, hi, low, high): sums of the bounds of names, and the limits within them; NULL limits are none."""
    at = [*keys, "industry"]
    sums = names.groupBy(*at).agg(F.sum("lb").alias("lo"), F.sum("ub").alias("hi"))
    held = limits.where("kind = 'industry'").select(*keys, F.col("key").alias("industry"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    low, high = F.greatest("lo", F.coalesce("_lo", "lo")), F.least("hi", F.coalesce("_hi", "hi"))
    return join_groups(sums, held, at).select(*at, "lo", "hi", low.alias("low"), high.alias("high"))


def allocate_industries(names: DataFrame, limits: DataFrame, keys: Sequence[str] = KEYS, max_rows: int | None = None) -> DataFrame:
    """Add ``weight``, ``status_code`` and ``nu``, the price of the name's industry, under the industry limits.

    ``names`` as for `allocate`, with ``industry``; ``limits`` as `group_bounds`
    gives them, other kinds are ignored. Groups whose limits contradict each
    other get weight 0. ``names`` is read twice; write it first if it is
    expensive.
    """
    at, within = list(keys), [*keys, "industry"]
    sides = cut_lineage(industry_sides(names, limits, keys))
    totals = cut_lineage(price_steps(names, within, max_rows))
    ends = {
        "low": price_of_level(totals, sides.where(F.col("low") > F.col("lo")).select(*within, "lo", F.col("low").alias("level")), within),
        "high": price_of_level(totals, sides.where(F.col("high") < F.col("hi")).select(*within, "lo", F.col("high").alias("level")), within),
    }
    ends = {side: cut_lineage(found) for side, found in ends.items()}
    # what an industry weighs between its limits moves on, from the price of the lower to that of the upper one
    started = F.when(F.col("low") > F.col("lo"), before(F.col("low"))).otherwise(F.lit(False))
    stopped = F.when(F.col("high") < F.col("hi"), ~before(F.col("high"))).otherwise(F.lit(False))
    steps = join_groups(totals, sides, within).where(~started & ~stopped).select(*at, "nu", "step", "gamma")
    for side, sign in (("low", 1), ("high", -1)):
        steps = steps.unionByName(ends[side].select(*at, "nu", (F.col("growing") * sign).alias("step"), "gamma"))
    merged = steps.groupBy(*at, "nu").agg(F.sum("step").alias("step"), F.first("gamma").alias("gamma"))
    crossed = names.groupBy(*at).agg(F.count_if(F.col("lb") > F.col("ub")).alias("crossed"))
    whole = sides.groupBy(*at).agg(
        F.sum("low").alias("lo"), F.sum("high").alias("hi"), F.count_if(F.col("low") > F.col("high") + 1e-9).alias("split")
    )
    budget = price_of_level(running_steps(merged, at, max_rows), whole.select(*at, "lo", F.lit(1.0).alias("level")), at)
    possible = (F.col("crossed") == 0) & (F.col("split") == 0) & (F.col("lo") <= 1 + 1e-9) & (F.col("hi") >= 1 - 1e-9)
    status = whole.join(crossed, at).join(budget.select(*at, "nu"), at, "left").select(
        *at, F.col("nu").alias("_nu"), F.when(possible, OPTIMAL).otherwise(INFEASIBLE).alias("status_code")
    )
    prices = sides.select(*within)
    for side, found in ends.items():
        prices = join_groups(prices, found.select(*within, F.col("nu").alias(f"_{side}")), within)
    nu = F.greatest(F.least("_nu", "_low"), F.col("_high"))  # NULL bounds are passed over
    priced = join_groups(names, prices, within).join(status, at).withColumn("nu", nu).drop("_nu", "_low", "_high")
    weight = F.greatest(F.coalesce(weight_at(F.col("nu")), F.col("lb")), F.lit(0.0))
    return priced.withColumn("weight", F.when(F.col("status_code") == OPTIMAL, weight).otherwise(0.0))


def portfolio_sums(weights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, constituent, turnover, deviation): what the limits of the whole portfolio hold."""
    w = F.col("weight")
    return weights.groupBy(*keys).agg(
        F.sum(F.when(F.col("is_constituent"), w).otherwise(0.0)).alias("constituent"),
        F.coalesce(F.sum(F.abs(w - F.col("prev_weight"))), F.lit(0.0)).alias("turnover"),
        F.sqrt(F.sum((w - F.col("ref")) * (w - F.col("ref")))).alias("deviation"),
    )


def _broken(value: Column) -> Column:
    """By how much a value breaks lo or hi."""
    none = F.lit(0.0)
    return F.greatest(F.coalesce(value - F.col("hi"), none), F.coalesce(F.col("lo") - value, none), none)


def _value() -> Column:
    out = F.lit(None).cast("double")
    for kind in WHOLE:
        out = F.when(F.col("kind") == kind, F.col(kind)).otherwise(out)
    return out


def _at_price(names: DataFrame, price: Column) -> DataFrame:
    """Names with the price of their group's limit in alpha, kappa or gamma."""
    kind, zero = F.col("kind"), F.lit(0.0)
    signed = F.when(F.col("lo").isNotNull(), price).otherwise(-price)
    return names.withColumns(
        {
            "alpha": F.col("alpha") + F.when((kind == "constituent") & F.col("is_constituent"), signed).otherwise(zero),
            "kappa": F.coalesce("kappa", zero) + F.when(kind == "turnover", price).otherwise(zero),
            "gamma": F.col("gamma") * F.when(kind == "deviation", F.pow(F.lit(2.0), price)).otherwise(F.lit(1.0)),
        }
    )


def allocate_limited(
    names: DataFrame,
    limits: DataFrame,
    keys: Sequence[str] = KEYS,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    max_rows: int | None = None,
) -> DataFrame:
    """Add ``weight``, ``status_code``, ``kind`` and ``limit_price`` under limits on industries and on the whole portfolio.

    ``kind`` is the limit of the portfolio that has a price, NULL if none needs
    one. A group is infeasible when its bounds or industries contradict each
    other, or when a limit of the portfolio is broken at every price. One
    portfolio limit may bind at a time; a group where a second one is broken by
    more than ``tolerance`` then ends as ``not_converged``. Style limits are
    not met here. Rows per job: names of groups under search times five, later
times three.
    """
    at = list(keys)
    names, limits = cut_lineage(names), cut_lineage(limits)
    free = cut_lineage(allocate_industries(names, limits, keys, max_rows))
    whole = limits.where(F.col("kind").isin(*WHOLE)).select(*at, "kind", "lo", "hi")
    fine = free.where(F.col("status_code") == OPTIMAL)
    order = F.array_position(F.array(*map(F.lit, WHOLE)), F.col("kind"))
    two_gamma = 2 * F.col("gamma")
    top = F.max(F.col("alpha") - two_gamma * (F.col("lb") - F.col("ref")) + F.coalesce("kappa", F.lit(0.0)))
    bottom = F.min(F.col("alpha") - two_gamma * (F.col("ub") - F.col("ref")) - F.coalesce("kappa", F.lit(0.0)))
    spans = names.groupBy(*at).agg((top - bottom + 1).alias("_span"))
    found = (
        whole.join(portfolio_sums(fine, keys), at)
        .withColumn("v0", _value())
        .where(_broken(F.col("v0")) > tolerance)
        .groupBy(*at)
        .agg(F.min(F.struct(order.alias("o"), "kind", "lo", "hi", "v0")).alias("s"))
        .select(*at, "s.kind", "s.lo", "s.hi", "s.v0")
        .join(spans, at)
        .withColumns({"p0": F.lit(0.0), "p1": F.when(F.col("kind") == "deviation", DOUBLINGS).otherwise(F.col("_span")), "v1": F.lit(None).cast("double"), "line": F.lit(None).cast("double"), "width": F.lit(None).cast("double"), "met": F.lit(True)})
        .drop("_span")
    )
    search = cut_lineage(found)
    settled = []
    for _ in range(rounds):
        tried = cut_lineage(_narrowed(names, limits, search, keys, max_rows))
        ends = F.least(F.abs(F.col("v1") - F.col("v0")), 10 * F.abs(F.col("v1") - _bound()))
        open_ = F.col("met") & (ends > tolerance)
        settled.append(tried.where(~open_))
        search = tried.where(open_)
        if search.isEmpty():
            break
    for part in settled:
        search = search.unionByName(part)
    # an end that is as close as that is the price itself
    price = F.when(10 * F.abs(F.col("v1") - _bound()) <= tolerance, F.col("p1")).otherwise(_line())
    last = cut_lineage(search.withColumn("limit_price", price))
    moved = allocate_industries(_at_price(names.join(last.where("met"), at), F.col("limit_price")).select(*names.columns, "kind", "limit_price"), limits, keys, max_rows)
    lost = free.join(last.where("not met").select(*at, "kind"), at).withColumns(
        {"weight": F.lit(0.0), "status_code": F.lit(INFEASIBLE), "limit_price": F.lit(None).cast("double")}
    )
    still = free.join(last.select(*at), at, "left_anti").withColumns({"kind": F.lit(None).cast("string"), "limit_price": F.lit(0.0)})
    cols = [*at, "code", "weight", "status_code", "kind", "limit_price"]
    out = moved.select(*cols).unionByName(lost.select(*cols)).unionByName(still.select(*cols))
    out = cut_lineage(names.join(out, [*at, "code"]))
    checked = whole.withColumnRenamed("kind", "_kind").join(portfolio_sums(out.where(F.col("status_code") == OPTIMAL), keys), at)
    checked = checked.withColumnRenamed("_kind", "kind").where(_broken(_value()) > tolerance)
    open_ = checked.select(*at).distinct().withColumn("_open", F.lit(True))
    late = F.coalesce("_open", F.lit(False))
    return out.join(open_, at, "left").withColumn("status_code", F.when(late, NOT_CONVERGED).otherwise(F.col("status_code"))).drop("_open")


def _bound() -> Column:
    return F.coalesce("hi", "lo")


def _line() -> Column:
    """The price within the bracket where the line through its ends meets the limit."""
    share = F.when(F.col("v1") == F.col("v0"), 1.0).otherwise((_bound() - F.col("v0")) / (F.col("v1") - F.col("v0")))
    return F.col("p0") + (F.col("p1") - F.col("p0")) * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def _narrowed(names: DataFrame, limits: DataFrame, search: DataFrame, keys: Sequence[str], max_rows: int | None) -> DataFrame:
    """The bracket of each group after trying prices in it; ``met`` is false if none meets the limit."""
    at = list(keys)
    p0, p1 = F.col("p0"), F.col("p1")
    whole = F.array(*[p0 + (p1 - p0) * x for x in FIRST])
    # a line misses by the square of its bracket's width; how far the last one missed shows in the present one
    miss = F.coalesce(CARE * F.abs(_line() - F.col("line")) * F.pow((p1 - p0) / F.col("width"), F.lit(2.0)), p1 - p0)
    far = F.greatest(F.least(miss, (p1 - p0) * NEAR), (p1 - p0) * LEAST)
    near = F.filter(F.array((p0 + p1) / 2, _line() - far, _line() + far), lambda p: (p > p0) & (p < p1))
    tried = search.select("*", F.posexplode(F.when(F.col("v1").isNull(), whole).otherwise(near)).alias("_j", "_p"))
    rows = _at_price(names.join(tried.select(*at, "_j", "_p", "kind", "lo", "hi"), at), F.col("_p"))
    rows = cut_lineage(rows.select(*at, "_j", *PRICED))
    each = limits.where("kind = 'industry'").join(tried.select(*at, "_j"), at)
    sums = portfolio_sums(allocate_industries(rows, each, [*at, "_j"], max_rows), [*at, "_j"])
    seen = tried.join(sums, [*at, "_j"]).withColumn("_v", _value()).withColumn("_ok", _broken(F.col("_v")) <= 0)
    first = seen.groupBy(*at).agg(F.min(F.when(F.col("_ok"), F.struct("_p", "_v"))).alias("_end"))
    start = seen.where(~F.col("_ok")).join(first, at).where(F.col("_end").isNull() | (F.col("_p") < F.col("_end._p")))
    start = start.groupBy(*at).agg(F.max(F.struct("_p", "_v")).alias("_start"))
    return search.join(first, at, "left").join(start, at, "left").select(
        *at, "kind", "lo", "hi",
        F.coalesce("_start._v", "v0").alias("v0"), F.coalesce("_start._p", "p0").alias("p0"),
        F.coalesce("_end._p", "p1").alias("p1"), F.coalesce("_end._v", "v1").alias("v1"),
        F.when(F.col("v1").isNotNull(), _line()).alias("line"), F.when(F.col("v1").isNotNull(), F.col("p1") - F.col("p0")).alias("width"),
        (F.col("_end").isNotNull() | F.col("v1").isNotNull()).alias("met"),
    )
