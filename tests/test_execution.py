"""Fills, deferred sales and their value on a hand-made week."""

from datetime import date

import pytest

from tidefolio.operators import execution as ex
from tidefolio.operators.calendar import trading_calendar

D = [date(2024, 1, d) for d in range(1, 8)]
BUY, SELL = 0.001, 0.002


def panel(spark, cells):
    """Cells (day, code, price, state): state may stop a buy (up), a sale (down), both (halt); None has no price."""
    rows = []
    for day, code, price, state in cells:
        up, down = {"up": (0.5, 0.1), "down": (99.0, 99.0)}.get(state, (99.0, 0.1))
        rows.append((D[day], code, price, price, 1.0, up, down, "停牌" if state == "halt" else "交易"))
    return spark.createDataFrame(
        rows, "date date, code string, adj_vwap double, adj_close double, close double, limit_up double, limit_down double, trade_status string"
    )


def weights(spark, rows):
    return spark.createDataFrame([("s", D[d], c, w) for d, c, w in rows], "scenario_id string, date date, code string, weight double")


@pytest.fixture(params=[None, 100])
def run(spark, request):
    """Book and net values, by both plans of the group sums."""

    def go(cells, targets, **how):
        p, w = panel(spark, cells), weights(spark, targets)
        days, prices = trading_calendar(p), ex.trade_prices(p)
        book = ex.trade_book(w, days, prices, max_rows=request.param, **how)
        nav = {r.date: r.nav for r in ex.drift_nav(w, days, prices, max_rows=request.param).collect()}
        return book, nav, days, prices

    return go


CELLS = [(d, c, 1.0, None) for d in range(7) for c in "ab"]


def changed(**at):
    """CELLS with (price, state) replaced at keys like a3."""
    return [(d, c, *at.get(f"{c}{d}", (p, s))) for d, c, p, s in CELLS]


def test_blocked_buy_leaves_cash(run):
    book, nav, days, prices = run(changed(a1=(1.0, "up"), b3=(2.0, None)), [(0, "a", 0.5), (0, "b", 0.5)])
    assert nav[D[0]] == 1.0
    assert nav[D[1]] == pytest.approx(1 - 0.5 * BUY)
    assert nav[D[3]] == pytest.approx(1 - 0.5 * BUY + 0.5)  # b doubles, a was never bought
    values = ex.period_values(book.held, book.cash, book.proceeds, days, prices)
    stats = ex.execution_statistics(book.filled, values, ex.days_before_first(weights_of(book), book.plan, days)).first()
    assert (stats.buy_fail_count, stats.sell_defer_count) == (1, 0)


def weights_of(book):
    return book.plan.selectExpr("scenario_id", "signal_date as date")


def test_buys_are_scaled_to_the_cash_left(run):
    book, nav, *_ = run(CELLS, [(0, "a", 0.6), (0, "b", 0.4)])
    scale = 1 / (1 + BUY)
    filled = {r.code: r.filled for r in book.filled.collect()}
    assert filled == {"a": pytest.approx(0.6 * scale), "b": pytest.approx(0.4 * scale)}
    assert nav[D[1]] == pytest.approx(scale)
    cost = ex.trading_costs(book.filled).first()
    assert cost.turnover == pytest.approx(scale) and cost.cost == pytest.approx(scale * BUY)


def test_deferred_sale_is_made_on_the_first_open_day(run):
    """All a on day 1; day 3 wants b, but a cannot be sold before day 5, at another price."""
    cells = changed(a3=(1.0, "down"), a4=(3.0, "halt"), a5=(4.0, None), a6=(9.0, None))
    book, nav, *_ = run(cells, [(0, "a", 0.5), (2, "b", 0.8)])
    held = {(r.exec_date, r.code): (r.units, r.until) for r in book.held.collect()}
    assert held[(D[3], "a")] == (pytest.approx(0.5), D[5])
    before = 1 - 0.5 * BUY  # value on day 3 before trading, which starts from the drifted target: half a, half cash
    bought = min(0.8, 0.5 / (1 + BUY))
    cash = 0.5 - bought * (1 + BUY)
    assert nav[D[3]] == pytest.approx(before * (0.5 + bought + cash))
    assert nav[D[4]] == pytest.approx(before * (1.5 + bought + cash))  # still held on day 4
    sold = 0.5 * 4.0 * (1 - SELL)
    assert nav[D[5]] == pytest.approx(before * (sold + bought + cash))
    assert nav[D[6]] == pytest.approx(before * (sold + bought + cash))  # the rise of day 6 is missed
    turnover = {r.exec_date: r.turnover for r in ex.trading_costs(book.filled).collect()}
    assert turnover[D[3]] == pytest.approx(bought)  # the blocked sale is no trade of day 3


def test_sale_on_the_day_of_the_next_execution_counts_in_its_growth(run, spark):
    cells = changed(a3=(1.0, "down"), a4=(1.0, "down"), a5=(2.0, None))
    book, nav, _, prices = run(cells, [(0, "a", 0.5), (2, "b", 0.0), (2, "a", 0.1), (4, "b", 0.3)])
    held = {(r.exec_date, r.code, r.until): r.units for r in book.held.collect()}
    assert held[(D[3], "a", D[5])] == pytest.approx(0.4)
    grown = {r.exec_date: r.growth for r in ex.period_growth(book.held, book.cash, book.proceeds, prices).collect()}
    assert grown[D[5]] == pytest.approx(0.5 + 0.4 * 2 * (1 - SELL) + 0.1 * 2)


def test_unpriced_name_is_held_on(run):
    cells = changed(a3=(None, None), a4=(2.0, None))
    book, nav, *_ = run(cells, [(0, "a", 0.5), (2, "b", 0.2)])
    kept = [r for r in book.held.collect() if r.exec_date == D[3] and r.code == "a"]
    assert len(kept) == 1 and kept[0].units == pytest.approx(0.5 / 0.5)  # of the value that has a price
    assert nav[D[4]] > nav[D[3]] + 0.9


def test_changes_under_one_yuan_are_left_alone(run):
    book, *_ = run(CELLS, [(0, "a", 0.5), (2, "a", 0.500000001)], value=1e8)
    assert [r.filled for r in book.filled.where("exec_date = '2024-01-04'").collect()] == [0.0]
