"""Orders, fills and the value of held weights, for many strategies at once.

A signal of date T is traded at the average price of the next trading day and
valued at closes until the next trade. All of it is set-based: what the fills
of a day leave is held over an interval of days and meets prices in an equi
join on (date, code). Blocked and unpriced orders stay undone, buys are scaled
to the cash there is, and a blocked sale is made on the first open day after.
Every period starts from the last targets, drifted: what a blocked order leaves
counts in its own period's value and cash and is not carried into the next.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import cannot_buy, cannot_sell, positive, ratio
from tidefolio.operators.calendar import execution_dates, holding_days
from tidefolio.operators.groups import with_aggregates
from tidefolio.session import cut_lineage

KEYS = ("scenario_id",)


def trade_prices(panel: DataFrame) -> DataFrame:
    """(date, code, price, value_price, cant_buy, cant_sell) of the panel; bad prices are NULL."""
    return panel.select(
        "date",
        "code",
        positive(F.col("adj_vwap")).alias("price"),
        positive(F.col("adj_close")).alias("value_price"),
        cannot_buy().alias("cant_buy"),
        cannot_sell().alias("cant_sell"),
    )


def schedule(weights: DataFrame, calendar: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, signal_date, exec_date, next_exec_date) of every rebalance that trades."""
    return execution_dates(calendar, weights, keys).withColumnRenamed("date", "signal_date")


def target_positions(
    weights: DataFrame, plan: DataFrame, prices: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, signal_date, exec_date, next_exec_date, code, weight, units) of a schedule.

    ``units`` is weight over the execution price per unit of portfolio value;
    NULL, and so cash, where the name has no price that day.
    """
    held = weights.where(F.col("weight") != 0).select(*keys, F.col("date").alias("signal_date"), "code", "weight")
    at = prices.select(F.col("date").alias("exec_date"), "code", "price")
    return (
        held.join(plan, [*keys, "signal_date"])
        .join(at, ["exec_date", "code"], "left")
        .withColumn("units", ratio(F.col("weight"), F.col("price")))
        .drop("price")
    )


def drifted(positions: DataFrame, plan: DataFrame, prices: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Last period's targets at the next execution, and the value they add up to.

    (keys, exec_date, code, current) as shares of that value, and
    (keys, exec_date, growth): the value over the last period's start.
    """
    at = [*keys, "exec_date"]
    here = prices.where(F.col("price").isNotNull()).select(F.col("date").alias("exec_date"), "code", "price")
    valued = (
        positions.where(F.col("units").isNotNull() & F.col("next_exec_date").isNotNull())
        .select(*keys, F.col("next_exec_date").alias("exec_date"), "code", "units")
        .join(here, ["exec_date", "code"])
        .withColumn("_value", F.col("units") * F.col("price"))
    )
    bought = positions.where(F.col("units").isNotNull()).groupBy(*at).agg(F.sum("weight").alias("_in"))
    cash = plan.where(F.col("next_exec_date").isNotNull()).join(bought, at, "left")
    growth = (
        cash.select(*keys, F.col("next_exec_date").alias("exec_date"), (1 - F.coalesce("_in", F.lit(0.0))).alias("cash"))
        .join(valued.groupBy(*at).agg(F.sum("_value").alias("_sum")), at, "left")
        .select(*at, (F.coalesce("_sum", F.lit(0.0)) + F.col("cash")).alias("growth"))
    )
    shares = valued.join(growth, at).select(*at, "code", ratio(F.col("_value"), F.col("growth")).alias("current"))
    return shares, growth


def orders(positions: DataFrame, plan: DataFrame, prices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, exec_date, next_exec_date, code, current, target, delta, side, blocked, priced, price).

    ``current`` is the drifted share of the last period's names at the day's
    average prices, ``target`` the new weight; both as shares of the value
    before trading.
    """
    at = [*keys, "exec_date"]
    shares, _ = drifted(positions, plan, prices, keys)
    targets = positions.select(*at, "code", F.lit(0.0).alias("current"), F.col("weight").alias("target"))
    both = targets.unionByName(shares.select(*at, "code", "current", F.lit(0.0).alias("target")))
    net = both.groupBy(*at, "code").agg(F.sum("current").alias("current"), F.sum("target").alias("target"))
    flags = prices.select(F.col("date").alias("exec_date"), "code", "price", "cant_buy", "cant_sell")
    buys = F.col("delta") > 0
    no = F.lit(False)
    return (
        net.join(plan.select(*at, "next_exec_date"), at)
        .join(flags, ["exec_date", "code"], "left")
        .withColumn("delta", F.col("target") - F.col("current"))
        .withColumn("side", F.when(buys, "buy").when(F.col("delta") < 0, "sell"))
        .withColumn("blocked", F.when(buys, F.coalesce("cant_buy", no)).otherwise(F.coalesce("cant_sell", no)))
        .withColumn("priced", F.col("price").isNotNull())
        .select(*at, "next_exec_date", "code", "current", "target", "delta", "side", "blocked", "priced", "price")
    )


def scaled_orders(
    orders: DataFrame,
    value: float = 1e8,
    cost_buy: float = K.BUY_COST,
    cost_sell: float = K.SELL_COST,
    keys: Sequence[str] = KEYS,
    max_rows: int | None = None,
) -> DataFrame:
    """Add ``filled``, the traded share of value, sales first, and ``waiting``, the share that a blocked sale leaves to sell.

    Changes below one yuan of ``value`` are left alone, blocked or unpriced
    orders stay unfilled, and buys are scaled to the cash that sales leave.
    """
    at = [*keys, "exec_date"]
    size = F.abs("delta")
    meant = (size * value > K.MIN_TRADE) & F.col("priced")
    live = meant & ~F.col("blocked")
    sums = {
        "_current": F.sum("current"),
        "_sold": F.sum(F.when(live & (F.col("side") == "sell"), size).otherwise(0.0)),
        "_demand": F.sum(F.when(live & (F.col("side") == "buy"), size).otherwise(0.0)),
    }
    out = with_aggregates(orders, at, sums, max_rows)
    cash = 1 - F.col("_current") + F.col("_sold") * (1 - cost_sell)
    scale = F.least(F.lit(1.0), cash / (F.col("_demand") * (1 + cost_buy) + 1e-8 / value))
    traded = F.when(live & (F.col("side") == "sell"), -size).when(
        live & (F.col("side") == "buy") & (size * scale * value >= K.MIN_TRADE), size * scale
    ).otherwise(0.0)
    waits = F.when(meant & F.col("blocked") & (F.col("side") == "sell"), size).otherwise(0.0)
    return out.withColumns({"filled": traded, "waiting": waits}).drop(*sums)


def trading_costs(
    filled: DataFrame, cost_buy: float = K.BUY_COST, cost_sell: float = K.SELL_COST, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, exec_date, turnover, cost): two-way turnover and fees of what was filled that day, as shares of value."""
    up = F.sum(F.when(F.col("filled") > 0, F.col("filled")).otherwise(0.0))
    down = F.sum(F.when(F.col("filled") < 0, -F.col("filled")).otherwise(0.0))
    return filled.groupBy(*keys, "exec_date").agg(
        (up + down).alias("turnover"), (up * cost_buy + down * cost_sell).alias("cost")
    )


def deferred_sales(orders: DataFrame, prices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, exec_date, code, sale_date) of blocked sales.

    The sale happens on the first later day the name may be sold and has a
    price, up to the next execution, which ends the wait; else NULL.
    """
    waiting = orders.where((F.col("side") == "sell") & F.col("blocked") & F.col("priced")).select(
        *keys, "exec_date", "next_exec_date", "code"
    )
    # the nearest later open day of each day, once per (code, date); a waiting sale has a price row on its own day
    later = Window.partitionBy("code").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    open_day = F.when(~F.col("cant_sell") & F.col("price").isNotNull(), F.col("date"))
    next_open = prices.select(
        F.col("date").alias("exec_date"), "code", F.last(open_day, ignorenulls=True).over(later).alias("_open")
    )
    in_time = F.col("_open") <= F.coalesce("next_exec_date", F.col("_open"))
    return waiting.join(next_open, ["exec_date", "code"], "left").select(
        *keys, "exec_date", "code", F.when(in_time, F.col("_open")).alias("sale_date")
    )


def unpriced_holdings(positions: DataFrame, growth: DataFrame, prices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, exec_date, code, units) of last period's names without a price at the next execution; nobody can trade them."""
    here = prices.where(F.col("price").isNotNull()).select(F.col("date").alias("exec_date"), "code")
    return (
        positions.where(F.col("units").isNotNull() & F.col("next_exec_date").isNotNull())
        .select(*keys, F.col("next_exec_date").alias("exec_date"), "code", "units")
        .join(here, ["exec_date", "code"], "left_anti")
        .join(growth, [*keys, "exec_date"])
        .select(*keys, "exec_date", "code", ratio(F.col("units"), F.col("growth")).alias("units"))
    )


def holdings(filled: DataFrame, sales: DataFrame, kept: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, exec_date, code, units, until): what is held from each execution, per unit of value before trading.

    ``until`` is the day a deferred sale is made; the others, NULL, last as
    long as the period does.
    """
    at = [*keys, "exec_date", "code"]
    traded = filled.where("priced").withColumn("_left", F.col("current") + F.col("filled") - F.col("waiting"))
    never = F.lit(None).cast("date").alias("until")
    rest = traded.where(F.col("_left") != 0).select(*at, (F.col("_left") / F.col("price")).alias("units"), never)
    waits = traded.where(F.col("waiting") > 0).join(sales, at, "left")
    waits = waits.select(*at, (F.col("waiting") / F.col("price")).alias("units"), F.col("sale_date").alias("until"))
    return rest.unionByName(waits).unionByName(kept.select(*at, "units", never))


def opening_cash(
    filled: DataFrame, plan: DataFrame, cost_buy: float = K.BUY_COST, cost_sell: float = K.SELL_COST, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, exec_date, next_exec_date, cash): cash after the fills and fees of the day, not below zero."""
    at = [*keys, "exec_date"]
    paid = F.when(F.col("filled") > 0, F.col("filled") * (1 + cost_buy)).otherwise(F.col("filled") * (1 - cost_sell))
    left = filled.groupBy(*at).agg((1 - F.sum("current") - F.sum(paid)).alias("_cash"))
    return plan.join(left, at, "left").select(
        *at, "next_exec_date", F.greatest(F.coalesce("_cash", F.lit(1.0)), F.lit(0.0)).alias("cash")
    )


def sale_proceeds(held: DataFrame, prices: DataFrame, cost_sell: float = K.SELL_COST, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, exec_date, date, proceeds) of deferred sales on the days they are made, less fees."""
    at = prices.select(F.col("date").alias("until"), "code", "price")
    sold = held.where(F.col("until").isNotNull()).join(at, ["until", "code"])
    return sold.groupBy(*keys, "exec_date", F.col("until").alias("date")).agg(
        (F.sum(F.col("units") * F.col("price")) * (1 - cost_sell)).alias("proceeds")
    )


def period_values(
    held: DataFrame, cash: DataFrame, proceeds: DataFrame, calendar: DataFrame, prices: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, exec_date, date, growth, cash_share): value of a period's start capital on each day.

    Names without a close count nothing that day. Running totals go over the
    days of one period, of which there are no more than trading days.
    """
    at = [*keys, "exec_date"]
    plan = cash.select(*keys, F.col("exec_date").alias("date"), "exec_date")
    spans = holding_days(calendar, plan, keys).select(*at, "date")
    values = (
        held.join(spans, at)
        .where(F.col("until").isNull() | (F.col("date") < F.col("until")))
        .join(prices.where(F.col("value_price").isNotNull()).select("date", "code", "value_price"), ["date", "code"])
        .groupBy(*at, "date")
        .agg(F.sum(F.col("units") * F.col("value_price")).alias("_value"))
    )
    so_far = Window.partitionBy(*at).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    money = F.col("cash") + F.sum(F.coalesce("proceeds", F.lit(0.0))).over(so_far)
    growth = F.coalesce("_value", F.lit(0.0)) + F.col("_money")
    return (
        spans.join(cash.select(*at, "cash"), at)
        .join(values, [*at, "date"], "left")
        .join(proceeds, [*at, "date"], "left")
        .withColumn("_money", money)
        .select(*at, "date", growth.alias("growth"), ratio(F.col("_money"), growth).alias("cash_share"))
    )


def period_growth(held: DataFrame, cash: DataFrame, proceeds: DataFrame, prices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, exec_date, growth): value just before trading over that of the last execution.

    Deferred sales made up to that day are cash, the others are valued at its
    average prices.
    """
    at = [*keys, "exec_date"]
    spans = cash.where(F.col("next_exec_date").isNotNull())
    here = prices.where(F.col("price").isNotNull()).select(F.col("date").alias("next_exec_date"), "code", "price")
    values = (
        held.where(F.col("until").isNull())
        .join(spans.select(*at, "next_exec_date"), at)
        .join(here, ["next_exec_date", "code"])
        .groupBy(*at)
        .agg(F.sum(F.col("units") * F.col("price")).alias("_value"))
    )
    sold = proceeds.groupBy(*at).agg(F.sum("proceeds").alias("_sold"))
    none = F.lit(0.0)
    return (
        spans.join(values, at, "left")
        .join(sold, at, "left")
        .select(
            *keys,
            F.col("next_exec_date").alias("exec_date"),
            (F.col("cash") + F.coalesce("_value", none) + F.coalesce("_sold", none)).alias("growth"),
        )
    )


def execution_statistics(filled: DataFrame, values: DataFrame, before: DataFrame, keys: Sequence[str] = KEYS, value: float = 1e8) -> DataFrame:
    """(keys, buy_fail_count, sell_defer_count, avg_cash_pct); the days ``before`` the first execution are all cash."""
    stopped = F.col("blocked") & F.col("priced") & (F.abs("delta") * value > K.MIN_TRADE)
    counts = filled.groupBy(*keys).agg(
        F.count_if(stopped & (F.col("side") == "buy")).alias("buy_fail_count"),
        F.count_if(stopped & (F.col("side") == "sell")).alias("sell_defer_count"),
    )
    shares = values.select(*keys, "cash_share").unionByName(before.select(*keys, F.lit(1.0).alias("cash_share")))
    return counts.join(shares.groupBy(*keys).agg(F.avg("cash_share").alias("avg_cash_pct")), list(keys))


@dataclass
class Book:
    """What a back-test's figures are made of; the tables that several of them read are written once."""

    plan: DataFrame
    filled: DataFrame
    held: DataFrame
    cash: DataFrame
    proceeds: DataFrame


def trade_book(
    weights: DataFrame,
    calendar: DataFrame,
    prices: DataFrame,
    value: float = 1e8,
    cost_buy: float = K.BUY_COST,
    cost_sell: float = K.SELL_COST,
    keys: Sequence[str] = KEYS,
    max_rows: int | None = None,
) -> Book:
    """Fills of every execution and what they leave held; ``value`` is the capital that the least trade of one yuan refers to."""
    plan = cut_lineage(schedule(weights, calendar, keys))
    positions = cut_lineage(target_positions(weights, plan, prices, keys))
    filled = cut_lineage(scaled_orders(orders(positions, plan, prices, keys), value, cost_buy, cost_sell, keys, max_rows))
    _, growth = drifted(positions, plan, prices, keys)
    sales = deferred_sales(filled.where("waiting > 0"), prices, keys)
    held = cut_lineage(holdings(filled, sales, unpriced_holdings(positions, growth, prices, keys), keys))
    cash = opening_cash(filled, plan, cost_buy, cost_sell, keys)
    return Book(plan, filled, held, cash, sale_proceeds(held, prices, cost_sell, keys))


def drift_nav(
    weights: DataFrame,
    calendar: DataFrame,
    prices: DataFrame,
    cost_buy: float = K.BUY_COST,
    cost_sell: float = K.SELL_COST,
    keys: Sequence[str] = KEYS,
    value: float = 1e8,
    max_rows: int | None = None,
) -> DataFrame:
    """(keys, date, nav) from the first signal date on.

    Traded at the average prices of the execution day as far as orders fill,
    valued at closes. Days before the first execution stand at 1. Periods are
    chained by (keys, exec_date), of which there are no more than trading days.
    """
    return book_nav(trade_book(weights, calendar, prices, value, cost_buy, cost_sell, keys, max_rows), weights, calendar, prices, keys)


def book_nav(book: Book, weights: DataFrame, calendar: DataFrame, prices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """`drift_nav` of a book that other figures are read from too."""
    values = period_values(book.held, book.cash, book.proceeds, calendar, prices, keys)
    at = [*keys, "exec_date"]
    grown = period_growth(book.held, book.cash, book.proceeds, prices, keys)
    so_far = Window.partitionBy(*keys).orderBy("exec_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = (
        book.plan.select(*at)
        .join(grown, at, "left")
        .withColumn("_base", F.product(F.coalesce("growth", F.lit(1.0))).over(so_far))
        .select(*at, "_base")
    )
    nav = values.join(bases, at).select(*keys, "date", (F.col("growth") * F.col("_base")).alias("nav"))
    return days_before_first(weights, book.plan, calendar, keys).unionByName(nav)


def days_before_first(weights: DataFrame, plan: DataFrame, calendar: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, date, nav) with nav 1 from the first signal to the day before the first execution."""
    starts = weights.groupBy(*keys).agg(F.min("date").alias("_start"))
    firsts = plan.groupBy(*keys).agg(F.min("exec_date").alias("_first"))
    days = F.broadcast(calendar.select("date", "day"))
    return (
        starts.join(firsts, list(keys))
        .join(days.withColumnRenamed("date", "_start").withColumnRenamed("day", "_a"), "_start")
        .join(days.withColumnRenamed("date", "_first").withColumnRenamed("day", "_b"), "_first")
        .where(F.col("_b") > F.col("_a"))
        .select(*keys, F.explode(F.sequence("_a", F.col("_b") - 1)).alias("day"))
        .join(days, "day")
        .select(*keys, "date", F.lit(1.0).alias("nav"))
    )
