"""Execution, net values and their figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefolio.catalog.base import rounded, stored, with_panel
from tidefolio.catalog.benchmark import RETURNS
from tidefolio.catalog.registry import query
from tidefolio.functions import fixed as K
from tidefolio.operators import benchmark as bm, execution as ex, performance as pf, timeseries as ts
from tidefolio.operators.crosssection import share_of_total
from tidefolio.plans import backtest
from tidefolio.session import cut_lineage, new_table_path
from tidefolio.sources import sinks

# two strategies with their own rebalance dates
WEIGHTS = """
w0 AS (
  SELECT 'members' AS scenario_id, p.date, code, 1.0::DOUBLE AS x FROM panel p JOIN days d ON d.date = p.date
    WHERE is_hs300 = 1 AND trade_status <> '停牌' AND d.day % 4 = 1
  UNION ALL
  SELECT 'traded', p.date, code, amount FROM panel p JOIN days d ON d.date = p.date WHERE is_zz500 = 1 AND d.day % 6 = 2),
wts AS (SELECT scenario_id, date, code, x / sum(x) OVER (PARTITION BY scenario_id, date) AS weight FROM w0),
px AS (
  SELECT date, code, CASE WHEN adj_vwap > 0 THEN adj_vwap END AS price, CASE WHEN adj_vwap > 0 THEN adj_vwap END AS vprice,
    coalesce(trade_status = '停牌', false) OR coalesce(close >= limit_up * 0.999, false) AS cant_buy,
    coalesce(trade_status = '停牌', false) OR coalesce(close <= limit_down * 1.001, false) AS cant_sell FROM panel),
plan AS (
  SELECT scenario_id, r.date AS signal_date, d.next_date AS exec_date,
    lead(d.next_date) OVER (PARTITION BY scenario_id ORDER BY r.date) AS next_exec_date
  FROM (SELECT DISTINCT scenario_id, date FROM wts) r JOIN days d ON d.date = r.date WHERE d.next_date IS NOT NULL),
pos AS (
  SELECT p.*, w.code, w.weight, w.weight / x.price AS units FROM plan p
  JOIN wts w ON w.scenario_id = p.scenario_id AND w.date = p.signal_date
  LEFT JOIN px x ON x.date = p.exec_date AND x.code = w.code),
csh AS (SELECT p.scenario_id, p.exec_date, p.next_exec_date, 1 - coalesce(sum(s.weight) FILTER (WHERE s.units IS NOT NULL), 0) AS cash
  FROM plan p LEFT JOIN pos s ON s.scenario_id = p.scenario_id AND s.exec_date = p.exec_date GROUP BY 1, 2, 3),
gr AS (
  SELECT c.scenario_id, c.next_exec_date AS exec_date, c.cash + coalesce(sum(p.units * x.price), 0) AS growth
  FROM csh c LEFT JOIN pos p ON p.scenario_id = c.scenario_id AND p.exec_date = c.exec_date AND p.units IS NOT NULL
  LEFT JOIN px x ON x.date = c.next_exec_date AND x.code = p.code WHERE c.next_exec_date IS NOT NULL GROUP BY 1, 2, c.cash),
cur AS (
  SELECT p.scenario_id, p.next_exec_date AS exec_date, p.code, p.units * x.price / g.growth AS share
  FROM pos p JOIN px x ON x.date = p.next_exec_date AND x.code = p.code AND x.price IS NOT NULL
  JOIN gr g ON g.scenario_id = p.scenario_id AND g.exec_date = p.next_exec_date WHERE p.units IS NOT NULL),
ordr AS (
  SELECT o.*, target - cur AS delta, CASE WHEN target - cur > 0 THEN 'buy' WHEN target - cur < 0 THEN 'sell' END AS side,
    CASE WHEN target - cur > 0 THEN coalesce(x.cant_buy, false) ELSE coalesce(x.cant_sell, false) END AS blocked, x.price IS NOT NULL AS priced,
    l.next_exec_date
  FROM (SELECT coalesce(a.scenario_id, b.scenario_id) AS scenario_id, coalesce(a.exec_date, b.exec_date) AS exec_date,
          coalesce(a.code, b.code) AS code, coalesce(b.share, 0) AS cur, coalesce(a.weight, 0) AS target
        FROM pos a FULL JOIN cur b ON b.scenario_id = a.scenario_id AND b.exec_date = a.exec_date AND b.code = a.code) o
  JOIN plan l ON l.scenario_id = o.scenario_id AND l.exec_date = o.exec_date
  LEFT JOIN px x ON x.date = o.exec_date AND x.code = o.code),
sized AS (
  SELECT o.*, x.price, abs(delta) * 1e8 > 1 AND priced AS meant FROM ordr o LEFT JOIN px x ON x.date = o.exec_date AND x.code = o.code),
fil AS (
  SELECT *, CASE WHEN meant AND NOT blocked AND side = 'sell' THEN -abs(delta)
      WHEN meant AND NOT blocked AND side = 'buy' AND abs(delta) * sc * 1e8 >= 1 THEN abs(delta) * sc ELSE 0 END AS filled,
    CASE WHEN meant AND blocked AND side = 'sell' THEN abs(delta) ELSE 0 END AS waiting
  FROM (SELECT *, least(1.0, (1 - sum(cur) OVER w + coalesce(sum(abs(delta)) FILTER (WHERE meant AND NOT blocked AND side = 'sell') OVER w, 0) * 0.998)
      / (coalesce(sum(abs(delta)) FILTER (WHERE meant AND NOT blocked AND side = 'buy') OVER w, 0) * 1.001 + 1e-16)) AS sc
    FROM sized WINDOW w AS (PARTITION BY scenario_id, exec_date))),
fees AS (
  SELECT scenario_id, exec_date, sum(abs(filled)) AS turnover,
    sum(CASE WHEN filled > 0 THEN filled * 0.001 ELSE -filled * 0.002 END) AS cost FROM fil GROUP BY 1, 2),
sale AS (
  SELECT f.scenario_id, f.exec_date, f.code, f.waiting / f.price AS units, min(x.date) AS until FROM fil f
  LEFT JOIN px x ON x.code = f.code AND x.date > f.exec_date AND (f.next_exec_date IS NULL OR x.date <= f.next_exec_date)
    AND NOT x.cant_sell AND x.price IS NOT NULL
  WHERE f.waiting > 0 GROUP BY 1, 2, 3, f.waiting, f.price),
held AS (
  SELECT scenario_id, exec_date, code, (cur + filled - waiting) / price AS units, NULL::DATE AS until FROM fil WHERE priced
  UNION ALL SELECT * FROM sale
  UNION ALL SELECT p.scenario_id, p.next_exec_date, p.code, p.units / g.growth, NULL
    FROM pos p JOIN gr g ON g.scenario_id = p.scenario_id AND g.exec_date = p.next_exec_date
    WHERE p.units IS NOT NULL AND NOT EXISTS (SELECT 1 FROM px x WHERE x.date = p.next_exec_date AND x.code = p.code AND x.price IS NOT NULL)),
opening AS (
  SELECT p.scenario_id, p.exec_date, p.next_exec_date,
    greatest(coalesce(1 - sum(cur) - sum(CASE WHEN filled > 0 THEN filled * 1.001 ELSE filled * 0.998 END), 1), 0) AS cash
  FROM plan p LEFT JOIN fil f ON f.scenario_id = p.scenario_id AND f.exec_date = p.exec_date GROUP BY 1, 2, 3),
got AS (
  SELECT h.scenario_id, h.exec_date, h.until AS date, sum(h.units * x.price) * 0.998 AS money
  FROM held h JOIN px x ON x.date = h.until AND x.code = h.code GROUP BY 1, 2, 3),
worth AS (
  SELECT o.scenario_id, o.exec_date, d.date, sum(h.units * x.vprice) AS v FROM opening o
  JOIN days d ON d.date >= o.exec_date AND (o.next_exec_date IS NULL OR d.date < o.next_exec_date)
  LEFT JOIN held h ON h.scenario_id = o.scenario_id AND h.exec_date = o.exec_date AND (h.until IS NULL OR d.date < h.until)
  LEFT JOIN px x ON x.date = d.date AND x.code = h.code GROUP BY 1, 2, 3),
purse AS (
  SELECT w.*, o.cash + coalesce((SELECT sum(g.money) FROM got g WHERE g.scenario_id = w.scenario_id AND g.exec_date = w.exec_date AND g.date <= w.date), 0) AS money
  FROM worth w JOIN opening o ON o.scenario_id = w.scenario_id AND o.exec_date = w.exec_date),
pv AS (SELECT scenario_id, exec_date, date, money + coalesce(v, 0) AS growth, money / (money + coalesce(v, 0)) AS cash_share FROM purse),
grown AS (
  SELECT o.scenario_id, o.next_exec_date AS exec_date, o.cash + coalesce(sum(h.units * x.price), 0)
    + coalesce((SELECT sum(g.money) FROM got g WHERE g.scenario_id = o.scenario_id AND g.exec_date = o.exec_date), 0) AS growth
  FROM opening o LEFT JOIN held h ON h.scenario_id = o.scenario_id AND h.exec_date = o.exec_date AND h.until IS NULL
  LEFT JOIN px x ON x.date = o.next_exec_date AND x.code = h.code WHERE o.next_exec_date IS NOT NULL GROUP BY 1, 2, o.cash, o.exec_date),
base AS (
  SELECT p.scenario_id, p.exec_date, product(coalesce(g.growth, 1.0)) OVER (PARTITION BY p.scenario_id ORDER BY p.exec_date) AS base
  FROM plan p LEFT JOIN grown g ON g.scenario_id = p.scenario_id AND g.exec_date = p.exec_date),
early AS (
  SELECT s.scenario_id, d.date FROM (
    SELECT scenario_id, min(signal_date) AS a, min(exec_date) AS b FROM plan GROUP BY 1) s JOIN days d ON d.date >= s.a AND d.date < s.b),
nav AS (
  SELECT v.scenario_id, v.date, v.growth * b.base AS nav FROM pv v JOIN base b ON b.scenario_id = v.scenario_id AND b.exec_date = v.exec_date
  UNION ALL SELECT scenario_id, date, 1.0 FROM early)
"""
DAILY = WEIGHTS.rstrip() + "," + RETURNS.replace("adj_close", "adj_vwap").rstrip() + """,
bmr AS (SELECT date, coalesce(sum(ret), 0.0) / (SELECT count(DISTINCT code) FROM panel) AS bm_ret FROM rets GROUP BY 1),
dly AS (
  SELECT n.scenario_id, n.date, n.nav, coalesce(n.nav / lag(n.nav) OVER (PARTITION BY n.scenario_id ORDER BY n.date) - 1, 0) AS ret, coalesce(b.bm_ret, 0) AS bm_ret
  FROM nav n LEFT JOIN bmr b ON b.date = n.date),
dl AS (SELECT *, nav / bm_nav AS excess_nav FROM (
  SELECT *, product(1 + bm_ret) OVER (PARTITION BY scenario_id ORDER BY date) AS bm_nav FROM dly)),
sides AS (
  SELECT scenario_id, 'portfolio' AS side, date, ret, bm_ret FROM dly UNION ALL
  SELECT scenario_id, 'benchmark', date, bm_ret, 0.0 FROM dly)
"""


def figures_sql(source: str, keys: str) -> str:
    """Tables nv (net values) and mo (months) of a series (keys, date, ret, bm_ret)."""
    return f""",
nv0 AS (
  SELECT *, product(1 + ret) OVER (PARTITION BY {keys} ORDER BY date) AS n1,
    product(1 + ret) OVER (PARTITION BY {keys} ORDER BY date) / product(1 + bm_ret) OVER (PARTITION BY {keys} ORDER BY date) AS e1
  FROM {source}),
nv AS (
  SELECT *, n1 / max(n1) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS dd,
    e1 / max(e1) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS edd FROM nv0),
mo AS (
  SELECT {keys}, date_trunc('month', date)::DATE AS m, product(1 + ret) - 1 AS port_ret, product(1 + bm_ret) - 1 AS bm_ret,
    product(1 + ret) - product(1 + bm_ret) AS excess_ret FROM {source} GROUP BY ALL)
"""


def _weights(panel, days, n):
    at = panel.join(F.broadcast(days.select("date", "day")), "date")
    members = at.where((F.col("is_hs300") == 1) & (F.col("trade_status") != K.HALTED) & (F.col("day") % 4 == 1))
    traded = at.where((F.col("is_zz500") == 1) & (F.col("day") % 6 == 2))
    raw = members.select(F.lit("members").alias("scenario_id"), "date", "code", F.lit(1.0).alias("x")).unionByName(
        traded.select(F.lit("traded").alias("scenario_id"), "date", "code", F.col("amount").alias("x"))
    )
    shares = share_of_total(raw, "x", "weight", ["scenario_id", "date"], max_rows=n)
    return shares.select("scenario_id", "date", "code", "weight")


def _valued(spark, sf):
    """The stored panel with average prices as closes; the proxy's close is a maximum."""
    panel, days, n = stored(spark, sf)
    return panel.withColumn("adj_close", F.col("adj_vwap")), days, n


def _trades(spark, sf):
    panel, days, n = _valued(spark, sf)
    weights = _weights(panel, days, n)
    prices = ex.trade_prices(panel)
    plan = cut_lineage(ex.schedule(weights, days))
    return prices, ex.orders(cut_lineage(ex.target_positions(weights, plan, prices)), plan, prices)


def _book(spark, sf):
    panel, days, n = _valued(spark, sf)
    weights, prices = cut_lineage(_weights(panel, days, n)), ex.trade_prices(panel)
    book = ex.trade_book(weights, days, prices, max_rows=2 * n)
    return weights, days, prices, book


def _bench(panel, days):
    return bm.on_calendar(bm.equal_weight_return(ts.daily_returns(panel, days).select("date", "code", "ret")), days)


def _daily(spark, sf):
    panel, days, n = _valued(spark, sf)
    weights = cut_lineage(_weights(panel, days, n))
    return cut_lineage(backtest.set_based(weights, days, panel, _bench(panel, days), max_rows=2 * n))


def _reports(spark, sf):
    """Folder and names of the written report tables; the daily figures and the fees come from one panel and one book."""
    panel, days, n = _valued(spark, sf)
    weights, prices = cut_lineage(_weights(panel, days, n)), ex.trade_prices(panel)
    book = ex.trade_book(weights, days, prices, max_rows=2 * n)
    daily = cut_lineage(pf.against_benchmark(ex.book_nav(book, weights, days, prices), _bench(panel, days)))
    tables = backtest.report_tables(daily, ex.trading_costs(book.filled))
    path = new_table_path(spark, "report")
    sinks.write_tables(tables, path)
    return path, list(tables)


ORDER_COLS = "scenario_id, exec_date, code, round(cur, 6) AS current, round(target, 6) AS target, round(delta, 6) AS delta, side, blocked, priced"


@query(with_panel(f"SELECT {ORDER_COLS} FROM ordr", WEIGHTS))
def order_table(spark, sf):
    _, orders = _trades(spark, sf)
    return rounded(orders.drop("next_exec_date", "price"), "current", "target", "delta")


@query(with_panel("SELECT scenario_id, exec_date, code, round(filled, 6) AS filled, round(waiting, 6) AS waiting FROM fil", WEIGHTS))
def filled_orders(spark, sf):
    *_, book = _book(spark, sf)
    return rounded(book.filled.select("scenario_id", "exec_date", "code", "filled", "waiting"), "filled", "waiting")


@query(with_panel("""
SELECT o.scenario_id, o.exec_date, o.code, min(x.date) AS sale_date FROM ordr o
LEFT JOIN px x ON x.code = o.code AND x.date > o.exec_date AND (o.next_exec_date IS NULL OR x.date <= o.next_exec_date)
  AND NOT x.cant_sell AND x.price IS NOT NULL
WHERE o.side = 'sell' AND o.blocked AND o.priced GROUP BY 1, 2, 3""", WEIGHTS))
def deferred_sales(spark, sf):
    prices, orders = _trades(spark, sf)
    return ex.deferred_sales(orders, prices)


@query(with_panel("SELECT scenario_id, exec_date, code, round(sum(units) * 1000, 6) AS units, until FROM held WHERE units <> 0 GROUP BY 1, 2, 3, 5", WEIGHTS))
def holding_intervals(spark, sf):
    *_, book = _book(spark, sf)
    held = book.held.groupBy("scenario_id", "exec_date", "code", "until").agg((F.sum("units") * 1000).alias("units"))
    return rounded(held, "units")


@query(with_panel("""
SELECT o.scenario_id, o.buy_fail_count, o.sell_defer_count, round(c.avg_cash_pct, 6) AS avg_cash_pct FROM (
  SELECT scenario_id, count(*) FILTER (WHERE meant AND blocked AND side = 'buy') AS buy_fail_count,
    count(*) FILTER (WHERE meant AND blocked AND side = 'sell') AS sell_defer_count FROM fil GROUP BY 1) o
JOIN (SELECT scenario_id, avg(cash_share) AS avg_cash_pct FROM (
  SELECT scenario_id, cash_share FROM pv UNION ALL SELECT scenario_id, 1.0 FROM early) GROUP BY 1) c ON c.scenario_id = o.scenario_id""", WEIGHTS))
def execution_statistics(spark, sf):
    weights, days, prices, book = _book(spark, sf)
    values = ex.period_values(book.held, book.cash, book.proceeds, days, prices)
    before = ex.days_before_first(weights, book.plan, days)
    return rounded(ex.execution_statistics(book.filled, values, before), "avg_cash_pct")


@query(with_panel("SELECT scenario_id, exec_date, round(turnover, 6) AS turnover, round(cost, 8) AS cost FROM fees", WEIGHTS))
def turnover_and_costs(spark, sf):
    *_, book = _book(spark, sf)
    return rounded(rounded(ex.trading_costs(book.filled), "turnover"), "cost", places=8)


@query(with_panel("SELECT scenario_id, exec_date, date, round(growth, 6) AS growth, round(cash_share, 6) AS cash_share FROM pv", WEIGHTS))
def holding_period_values(spark, sf):
    _, days, prices, book = _book(spark, sf)
    return rounded(ex.period_values(book.held, book.cash, book.proceeds, days, prices), "growth", "cash_share")


@query(with_panel("SELECT scenario_id, date, round(nav, 6) AS nav FROM nav", WEIGHTS))
def drift_nav(spark, sf):
    panel, days, n = _valued(spark, sf)
    weights = cut_lineage(_weights(panel, days, n))
    return rounded(ex.drift_nav(weights, days, ex.trade_prices(panel), max_rows=2 * n), "nav")


@query(with_panel("""
SELECT scenario_id, date, round(nav, 6) AS nav, round(bm_nav, 6) AS bm_nav, round(excess_nav, 6) AS excess_nav,
  round(nav / max(nav) OVER (PARTITION BY scenario_id ORDER BY date) - 1, 6) AS drawdown,
  round(excess_nav / max(excess_nav) OVER (PARTITION BY scenario_id ORDER BY date) - 1, 6) AS excess_drawdown,
  round(ret, 6) AS ret, round(bm_ret, 6) AS bm_ret, round(ret - bm_ret, 6) AS excess_ret FROM dl""", DAILY))
def daily_timeseries(spark, sf):
    daily = _daily(spark, sf)
    cols = ["nav", "bm_nav", "excess_nav", "drawdown", "excess_drawdown", "ret", "bm_ret", "excess_ret"]
    return rounded(daily.select("scenario_id", "date", *cols), *cols)


RF = "(pow(1.02::DOUBLE, 1.0 / 252) - 1)"
FIGURES = f"""
fig AS (
  SELECT a.*, annual_return / (abs(max_drawdown) + 1e-12) AS calmar, annual_excess_return / (tracking_error + 1e-12) AS info_ratio,
    annual_excess_return / (abs(excess_max_drawdown) + 1e-12) AS excess_calmar, b.win_rate_monthly, b.avg_monthly_excess
  FROM (SELECT scenario_id, side, pow(product(1 + ret), 252.0 / count(*)) - 1 AS annual_return, stddev_samp(ret) * sqrt(252.0) AS annual_vol,
      (avg(ret) - {RF}) / (stddev_samp(ret) + 1e-12) * sqrt(252.0) AS sharpe, min(dd) AS max_drawdown,
      avg(ret - bm_ret) * 252 AS annual_excess_return, stddev_samp(ret - bm_ret) * sqrt(252.0) AS tracking_error, min(edd) AS excess_max_drawdown
    FROM nv GROUP BY 1, 2) a
  JOIN (SELECT scenario_id, side, avg(CASE WHEN excess_ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate_monthly, avg(excess_ret) AS avg_monthly_excess
    FROM mo GROUP BY 1, 2) b ON b.scenario_id = a.scenario_id AND b.side = a.side)
"""
_TALL = " UNION ALL ".join(f"SELECT scenario_id, '{m}' AS metric, side, {m} AS v FROM fig" for m in K.METRICS)


@query(with_panel(f"""
SELECT scenario_id, metric, round(max(sign(v) * ln(1 + abs(v))) FILTER (WHERE side = 'portfolio'), 6) AS portfolio,
  round(max(sign(v) * ln(1 + abs(v))) FILTER (WHERE side = 'benchmark'), 6) AS benchmark
FROM ({_TALL}) GROUP BY 1, 2""", DAILY.rstrip() + figures_sql("sides", "scenario_id, side").rstrip() + "," + FIGURES))
def performance_metrics(spark, sf):
    # monthly noise annualised by days is huge; logarithms keep the figures comparable
    tall = pf.tall_metrics(_daily(spark, sf))
    sides = ["portfolio", "benchmark"]
    return rounded(tall.withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in sides}), *sides)


FULL_COLS = ["port_ret", "bm_ret", "excess_ret", "vol", "max_dd", "sharpe", "calmar", "info_ratio", "excess_te", "excess_dd"]
_FULL = ", ".join(
    f"round(sign(v) * ln(1 + abs(v)), 6) AS {name}".replace("v)", f"{col})")
    for name, col in zip(
        FULL_COLS,
        "p.annual_return b.annual_return p.annual_excess_return p.annual_vol p.max_drawdown p.sharpe p.calmar p.info_ratio p.tracking_error p.excess_max_drawdown".split(),
    )
)


@query(with_panel(f"""
SELECT p.scenario_id, d.n_days, {_FULL} FROM fig p
JOIN fig b ON b.scenario_id = p.scenario_id AND b.side = 'benchmark'
JOIN (SELECT scenario_id, count(*) AS n_days FROM dly GROUP BY 1) d ON d.scenario_id = p.scenario_id
WHERE p.side = 'portfolio'""", DAILY.rstrip() + figures_sql("sides", "scenario_id, side").rstrip() + "," + FIGURES))
def yearly_full_period(spark, sf):
    full = pf.yearly_table(_daily(spark, sf)).where(F.col("year").isNull()).drop("year")
    return rounded(full.withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in FULL_COLS}), *FULL_COLS)


YEARLY_COLS = ["port_ret", "bm_ret", "excess_ret", "vol", "max_dd", "sharpe", "calmar", "info_ratio", "excess_te", "excess_dd"]


@query(with_panel(f"""
SELECT scenario_id, year, n_days, round(p, 5) AS port_ret, round(b, 5) AS bm_ret, round((1 + p) / (1 + b) - 1, 5) AS excess_ret,
  round(CASE WHEN n_days > 1 THEN s * sqrt(252.0) ELSE 0 END, 5) AS vol, round(mdd, 5) AS max_dd,
  round(CASE WHEN n_days > 1 THEN m / (s + 1e-12) * sqrt(252.0) ELSE 0 END, 5) AS sharpe,
  round((pow(1 + p, 252.0 / n_days) - 1) / (abs(mdd) + 1e-12), 5) AS calmar,
  round(me * 252 / (CASE WHEN n_days > 1 THEN se * sqrt(252.0) ELSE 0 END + 1e-12), 5) AS info_ratio,
  round(CASE WHEN n_days > 1 THEN se * sqrt(252.0) ELSE 0 END, 5) AS excess_te, round(edd, 5) AS excess_dd
FROM (SELECT scenario_id, year, count(*) AS n_days, product(1 + ret) - 1 AS p, product(1 + bm_ret) - 1 AS b, stddev_samp(ret) AS s, avg(ret) AS m,
    avg(ret - bm_ret) AS me, stddev_samp(ret - bm_ret) AS se, min(dd) AS mdd, min(edd) AS edd FROM nv GROUP BY 1, 2)
""", DAILY.rstrip() + """,
yr AS (SELECT *, year(date)::INTEGER AS year FROM dly)""" + figures_sql("yr", "scenario_id, year")))
def yearly_breakdown(spark, sf):
    out = pf.yearly_table(_daily(spark, sf)).where(F.col("year").isNotNull())
    return rounded(out, *YEARLY_COLS, places=5)


@query(with_panel("SELECT scenario_id, last_day(m) AS month, round(port_ret, 6) AS port_ret, round(bm_ret, 6) AS bm_ret, round(excess_ret, 6) AS excess_ret FROM mo",
                  DAILY.rstrip() + figures_sql("dly", "scenario_id")))
def monthly_excess(spark, sf):
    return rounded(pf.monthly_returns(_daily(spark, sf)), "port_ret", "bm_ret", "excess_ret")


_GRID = ", ".join(f"round(max(excess_ret) FILTER (WHERE month(m) = {i}) * 100, 5) AS m{i}" for i in range(1, 13))


@query(with_panel(f"SELECT scenario_id, year(m)::INTEGER AS year, {_GRID} FROM mo GROUP BY 1, 2", DAILY.rstrip() + figures_sql("dly", "scenario_id")))
def monthly_excess_grid(spark, sf):
    grid = pf.monthly_grid(pf.monthly_returns(_daily(spark, sf)))
    return rounded(grid, *[f"m{i}" for i in range(1, 13)], places=5)


@query(with_panel("""
SELECT scenario_id, year, month_of_year, round(avg(CASE WHEN excess_ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(excess_ret) * 100, 5) AS excess_pct
FROM (SELECT *, year(m)::INTEGER AS year, month(m)::INTEGER AS month_of_year FROM mo)
GROUP BY GROUPING SETS ((scenario_id, year), (scenario_id, month_of_year), (scenario_id))""", DAILY.rstrip() + figures_sql("dly", "scenario_id")))
def excess_win_rates(spark, sf):
    out = pf.win_rates(pf.monthly_returns(_daily(spark, sf)))
    return rounded(rounded(out, "win_rate"), "excess_pct", places=5)


@query(with_panel("""
SELECT 'timeseries' AS tbl, count(*) AS n FROM dly UNION ALL SELECT 'turnover', count(*) FROM fees
UNION ALL SELECT 'metrics', count(DISTINCT scenario_id) * 12 FROM dly
UNION ALL SELECT 'yearly', count(*) FROM (SELECT DISTINCT scenario_id, year(date) FROM dly)
UNION ALL SELECT 'monthly_excess', count(*) FROM mo""", DAILY.rstrip() + figures_sql("dly", "scenario_id")))
def report_store(spark, sf):
    path, tables = _reports(spark, sf)
    out = None
    for name in tables:
        one = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_panel("""
SELECT scenario_id, date, round(nav, 6) AS nav, round(bm_nav, 6) AS bm_nav, round(excess_nav, 6) AS excess_nav,
  round(nav / max(nav) OVER (PARTITION BY scenario_id ORDER BY date) - 1, 6) AS port_drawdown,
  round(excess_nav / max(excess_nav) OVER (PARTITION BY scenario_id ORDER BY date) - 1, 6) AS excess_drawdown,
  round(ret, 6) AS port_ret, round(bm_ret, 6) AS bm_ret FROM dl""", DAILY))
def report_store_timeseries(spark, sf):
    path, _ = _reports(spark, sf)
    stored = spark.read.parquet(f"{path}/timeseries")
    return rounded(stored, *[c for c in stored.columns if c not in ("scenario_id", "date")])
