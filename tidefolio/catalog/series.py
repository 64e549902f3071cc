"""Series over the calendar and scaling within a date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefolio.catalog.base import load, rounded, with_panel
from tidefolio.catalog.benchmark import RETURNS
from tidefolio.catalog.panel import ADV_SQL  # noqa: F401
from tidefolio.catalog.registry import query
from tidefolio.operators import calendar as cal, crosssection as xs, timeseries as ts
from tidefolio.operators.groups import average_ranks, quantiles
from tidefolio.plans import proxy

FORWARD = """
fwd AS (
  SELECT p.date, p.code, q.adj_close / p.adj_close - 1 AS fwd_ret
  FROM panel p JOIN days d ON d.date = p.date
  LEFT JOIN days e ON e.day = d.day + 2
  LEFT JOIN panel q ON q.date = e.date AND q.code = p.code)
"""


@query(with_panel("SELECT date, code, round(fwd_ret, 6) AS fwd_ret FROM fwd", FORWARD))
def forward_returns(spark, sf):
    panel, days, _ = load(spark, sf)
    return rounded(ts.forward_returns(panel, days, 2).select("date", "code", "fwd_ret"), "fwd_ret")


@query(with_panel("SELECT date, code, round(ret, 6) AS ret FROM rets", RETURNS))
def calendar_returns(spark, sf):
    panel, days, _ = load(spark, sf)
    return rounded(ts.daily_returns(panel, days).select("date", "code", "ret"), "ret")


@query(with_panel("SELECT date, count(fwd_ret) AS names FROM fwd GROUP BY 1 HAVING count(fwd_ret) > 8", FORWARD))
def valid_dates(spark, sf):
    panel, days, _ = load(spark, sf)
    return ts.valid_dates(ts.forward_returns(panel, days, 2), 8)


@query(with_panel("""
SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM days
  WHERE date BETWEEN DATE '1996-02-01' AND DATE '2000-11-30') WHERE (rn - 1) % 5 = 0"""))
def rebalance_calendar(spark, sf):
    return cal.rebalance_dates(proxy.calendar(spark, sf), 5, "1996-02-01", "2000-11-30")


@query(with_panel("SELECT date, next_date AS exec_date, lead(next_date) OVER (ORDER BY date) AS next_exec_date FROM days WHERE day % 4 = 1 AND next_date IS NOT NULL"))
def execution_calendar(spark, sf):
    days = proxy.calendar(spark, sf)
    return cal.execution_dates(days, days.where(F.col("day") % 4 == 1))


@query(with_panel("""
SELECT e.date AS signal_date, e.exec_date, d.date FROM ex e JOIN days d
  ON d.date >= e.exec_date AND (e.until IS NULL OR d.date < e.until)""", """
ex AS (SELECT date, next_date AS exec_date, lead(next_date) OVER (ORDER BY date) AS until
       FROM days WHERE day % 4 = 1 AND next_date IS NOT NULL)"""))
def holding_periods(spark, sf):
    days = proxy.calendar(spark, sf)
    return cal.holding_days(days, cal.execution_dates(days, days.where(F.col("day") % 4 == 1)))


def cost_sql(targets: str, universe: str) -> str:
    """Tables raw and costs for a filter on days d and one on the panel u."""
    return f"""
ct AS (SELECT d.date, d.day FROM days d WHERE {targets}),
raw AS (
  SELECT t.date, u.code,
         stddev_samp(CASE WHEN d.day > t.day - 19 THEN r.ret END) * sqrt(252.0)
           / sqrt(greatest(avg(p.amount), 1.0)) AS raw
  FROM ct t JOIN panel u ON u.date = t.date AND {universe}
  JOIN days d ON d.day BETWEEN t.day - 19 AND t.day
  JOIN panel p ON p.date = d.date AND p.code = u.code
  JOIN rets r ON r.date = p.date AND r.code = p.code
  GROUP BY 1, 2),
costs AS (
  SELECT r.date, r.code, CASE WHEN (SELECT count(*) FROM days d WHERE d.date <= r.date) < 5 THEN 1.0
     ELSE greatest(least(coalesce(CASE WHEN m.mid > 1e-12 THEN raw / m.mid ELSE raw END, 1.0), 10.0), 0.1) END AS cost
  FROM raw r JOIN (SELECT date, median(raw) AS mid FROM raw GROUP BY 1) m ON m.date = r.date)
"""


@query(with_panel("SELECT date, code, round(cost, 6) AS cost FROM costs",
                  RETURNS.rstrip() + "," + cost_sql("d.day % 10 = 2", "u.code NOT LIKE '%.BJ'")))
def impact_cost(spark, sf):
    panel, days, n = load(spark, sf)
    targets = days.where(F.col("day") % 10 == 2)
    universe = panel.where(~F.col("code").endswith(".BJ"))
    return rounded(ts.impact_costs(panel, days, targets, universe, max_rows=n), "cost")


@query(with_panel("""
SELECT date, code, round(amount / sum(amount) OVER (PARTITION BY date), 6) AS share,
  round((vwap - avg(vwap) OVER (PARTITION BY date)) / stddev_samp(vwap) OVER (PARTITION BY date), 6) AS z,
  round((vwap - avg(vwap) OVER (PARTITION BY date)) / stddev_pop(vwap) OVER (PARTITION BY date), 6) AS z_pop
FROM panel WHERE date IN (SELECT date FROM panel GROUP BY 1 HAVING count(*) > 1)"""))
def cross_section_scaling(spark, sf):
    panel, _, n = load(spark, sf)
    out = xs.share_of_total(panel, "amount", "share", max_rows=n)
    out = xs.zscore(out, "vwap", "z", min_std=1e-9, max_rows=n)
    out = xs.zscore(out, "vwap", "z_pop", ddof=0, max_rows=n)
    return rounded(out.select("date", "code", "share", "z", "z_pop"), "share", "z", "z_pop")


@query(with_panel("""
SELECT date, round(quantile_cont(vwap, 0.01), 6) AS q01, round(quantile_cont(vwap, 0.99), 6) AS q99,
       round(median(amount), 6) AS mid FROM panel GROUP BY 1"""))
def cross_section_quantiles(spark, sf):
    panel, _, n = load(spark, sf)
    tails = quantiles(panel, ["date"], "vwap", {"q01": 0.01, "q99": 0.99}, max_rows=n)
    mids = quantiles(panel, ["date"], "amount", {"mid": 0.5}, max_rows=n)
    return rounded(tails.join(mids, "date"), "q01", "q99", "mid")


@query(with_panel("""
SELECT date, code, rank() OVER (PARTITION BY date ORDER BY volume)
  + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0::DOUBLE AS rank FROM panel"""))
def average_tie_ranks(spark, sf):
    panel, _, n = load(spark, sf)
    return average_ranks(panel.select("date", "code", "volume"), ["date"], {"rank": "volume"}, n).drop("volume")


@query(with_panel("""
SELECT date, code, k, up <= k AS bottom, down <= k AS top FROM (
  SELECT date, code, greatest(CAST(floor(count(*) OVER (PARTITION BY date) * 0.2) AS BIGINT), 1) AS k,
    row_number() OVER (PARTITION BY date ORDER BY volume DESC, code) AS down,
    row_number() OVER (PARTITION BY date ORDER BY volume, code) AS up FROM panel)"""))
def quantile_groups(spark, sf):
    panel, _, n = load(spark, sf)
    out = xs.top_and_bottom(panel.select("date", "code", "volume"), "volume", 0.2, max_rows=n)
    return out.select("date", "code", "k", "bottom", "top")


SMOOTHED = """
s AS (SELECT p.date, d.day, p.code, (p.vwap - avg(p.vwap) OVER (PARTITION BY p.date)) AS s
      FROM panel p JOIN days d ON d.date = p.date),
runs AS (SELECT *, day - row_number() OVER (PARTITION BY code ORDER BY day) AS run FROM s),
starts AS (SELECT *, min(day) OVER (PARTITION BY code, run) AS day0 FROM runs),
sm AS (
  SELECT a.date, a.code,
         sum(b.s * pow(0.8::DOUBLE, a.day - b.day) * CASE WHEN b.day = b.day0 THEN 1.0 ELSE sqrt(1 - 0.8::DOUBLE * 0.8) END) AS f
  FROM starts a JOIN starts b ON b.code = a.code AND b.run = a.run AND b.day <= a.day GROUP BY 1, 2)
"""


@query(with_panel("SELECT date, code, round(f, 6) AS f FROM sm", SMOOTHED))
def decay_smoothing(spark, sf):
    panel, days, n = load(spark, sf)
    rows = xs.with_aggregates(cal.with_day(panel, days), ["date"], {"_mean": F.avg("vwap")}, n)
    signal = rows.select("date", "code", "day", (F.col("vwap") - F.col("_mean")).alias("s"), F.lit(0.8).alias("decay"))
    return rounded(ts.smooth(signal).select("date", "code", "f"), "f")
