"""Index weights and returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefolio.catalog.base import load, rounded, with_panel
from tidefolio.catalog.registry import query
from tidefolio.operators import benchmark as bm, calendar as cal, timeseries as ts

TIERS = """
tiers AS (
  SELECT date, code,
         CASE WHEN total_mv > 0 THEN total_mv END AS mv,
         CASE WHEN free_mv > 0 THEN free_mv END / CASE WHEN total_mv > 0 THEN total_mv END AS f
  FROM panel WHERE is_hs300 = 1),
adj AS (
  SELECT date, code, mv * CASE WHEN f > 0.8 THEN 1.0 WHEN f IS NOT NULL
         THEN CASE WHEN ceil(f * 10) / 10.0 < 0.1 THEN 0.1 ELSE ceil(f * 10) / 10.0 END END AS adj_mv
  FROM tiers)
"""
# weights with leavers carried: grid of codes and member dates
CARRIED = TIERS.rstrip() + """,
grid AS (SELECT d.date, c.code FROM (SELECT DISTINCT date FROM adj) d, (SELECT DISTINCT code FROM adj) c),
filled AS (
  SELECT g.date, g.code,
         last_value(adj_mv IGNORE NULLS) OVER (PARTITION BY g.code ORDER BY g.date) AS adj_mv
  FROM grid g LEFT JOIN adj a ON a.date = g.date AND a.code = g.code),
bmw AS (
  SELECT date, code, adj_mv / sum(adj_mv) OVER (PARTITION BY date) AS bm_weight
  FROM filled WHERE adj_mv IS NOT NULL)
"""
# returns between adjacent panel dates
RETURNS = """
rets AS (
  SELECT p.date, p.code, p.adj_close / q.adj_close - 1 AS ret
  FROM panel p JOIN days d ON d.date = p.date
  LEFT JOIN days e ON e.day = d.day - 1
  LEFT JOIN panel q ON q.date = e.date AND q.code = p.code)
"""


@query(with_panel("SELECT date, code, round(adj_mv, 6) AS adj_mv FROM adj", TIERS))
def tiered_adjusted_values(spark, sf):
    panel, _, _ = load(spark, sf)
    return rounded(bm.adjusted_values(panel, "hs300"), "adj_mv")


@query(with_panel("SELECT date, code, round(bm_weight, 6) AS bm_weight FROM bmw", CARRIED))
def benchmark_weights(spark, sf):
    panel, _, n = load(spark, sf)
    return rounded(bm.benchmark_weights(panel, "hs300", max_rows=n), "bm_weight")


@query(with_panel("""
SELECT date, code, round(adj_mv / sum(adj_mv) OVER (PARTITION BY date), 6) AS bm_weight
FROM (SELECT date, code, last_value(adj_mv IGNORE NULLS) OVER (PARTITION BY code ORDER BY date) AS adj_mv FROM adj)
WHERE adj_mv IS NOT NULL""", TIERS))
def benchmark_weights_members_only(spark, sf):
    panel, _, n = load(spark, sf)
    return rounded(bm.benchmark_weights(panel, "hs300", carry_leavers=False, max_rows=n), "bm_weight")


@query(with_panel("""
SELECT w.date, round(sum(w.bm_weight * r.ret), 6) AS bm_ret
FROM bmw w JOIN rets r ON r.date = w.date AND r.code = w.code AND r.ret IS NOT NULL GROUP BY 1""",
    CARRIED + "," + RETURNS))
def benchmark_return(spark, sf):
    panel, days, n = load(spark, sf)
    weights = bm.benchmark_weights(panel, "hs300", max_rows=n)
    returns = ts.daily_returns(panel, days).select("date", "code", "ret")
    return rounded(bm.weighted_return(weights, returns), "bm_ret")


@query(with_panel("""
SELECT date, round(coalesce(sum(ret), 0.0) / (SELECT count(DISTINCT code) FROM panel), 6) AS bm_ret
FROM rets GROUP BY 1""", RETURNS))
def equal_weight_benchmark(spark, sf):
    panel, days, _ = load(spark, sf)
    return rounded(bm.equal_weight_return(ts.daily_returns(panel, days).select("date", "code", "ret")), "bm_ret")


@query(with_panel("""
SELECT u.date, u.code, w.bm_date, round(CASE WHEN w.tot > 1e-8 THEN coalesce(b.bm_weight, 0) / w.tot
       ELSE coalesce(b.bm_weight, 0) END, 6) AS bm_weight
FROM uni u
JOIN (SELECT u2.date, a.bm_date, sum(coalesce(b2.bm_weight, 0)) AS tot
      FROM uni u2 JOIN near a ON a.date = u2.date
      LEFT JOIN bmw b2 ON b2.date = a.bm_date AND b2.code = u2.code AND b2.bm_weight > 0 GROUP BY 1, 2) w
  ON w.date = u.date
LEFT JOIN bmw b ON b.date = w.bm_date AND b.code = u.code AND b.bm_weight > 0
""", CARRIED + """,
targets AS (SELECT date FROM days WHERE day % 3 = 0),
uni AS (SELECT date, code FROM panel WHERE date IN (SELECT date FROM targets) AND code NOT LIKE '%.BJ'),
near AS (SELECT t.date, max(b.date) AS bm_date FROM targets t JOIN (SELECT DISTINCT date FROM bmw) b
         ON b.date <= t.date GROUP BY 1)"""))
def benchmark_weights_asof(spark, sf):
    panel, days, n = load(spark, sf)
    targets = cal.rebalance_dates(days, 3)
    weights = bm.benchmark_weights_at(panel, "hs300", targets, max_rows=n)
    universe = (
        panel.where(~F.col("code").endswith(".BJ"))
        .select("date", "code")
        .join(F.broadcast(targets), "date", "left_semi")
    )
    out = bm.benchmark_asof(universe, targets, weights, max_rows=n)
    return rounded(out.select("date", "code", "bm_date", "bm_weight"), "bm_weight")
