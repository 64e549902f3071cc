"""Whole jobs: rebalancing."""

from __future__ import annotations

from tidefolio.catalog.allocation import NAMES, SCENARIOS
from tidefolio.catalog.base import rounded, stored, with_panel
from tidefolio.catalog.registry import query
from tidefolio.plans import proxy_risk, rebalance

FIRST = NAMES.replace("d.day % 6 = 4", "d.day % 6 = 0").rstrip() + """,
sn AS (SELECT * FROM (VALUES ('enhanced', true, 0.2::DOUBLE, 10.0::DOUBLE), ('long_only', false, 0.2, 8.0), ('too_tight', false, 0.002, 0.05)) t(scenario_id, enh, cap, gamma)),
nb AS (
  SELECT scenario_id, gamma, date, code, CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 ELSE alpha0 END AS alpha,
    CASE WHEN enh THEN bm_weight ELSE 0.0 END AS ref, 0.0::DOUBLE AS lb,
    CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 ELSE cap END AS ub FROM names, sn),
bp AS (
  SELECT scenario_id, date, gamma, alpha - 2 * gamma * (lb - ref) AS nu, 1 AS step FROM nb UNION ALL
  SELECT scenario_id, date, gamma, alpha - 2 * gamma * (ub - ref), -1 FROM nb),
bs AS (SELECT scenario_id, date, gamma, nu, sum(step) AS step FROM bp GROUP BY ALL),
sl AS (SELECT *, sum(step) OVER w AS slope, lead(nu) OVER w AS nxt FROM bs WINDOW w AS (PARTITION BY scenario_id, date ORDER BY nu DESC)),
ms AS (SELECT *, coalesce(slope * (nu - nxt) / (2 * gamma), 0) AS gain,
         sum(coalesce(slope * (nu - nxt) / (2 * gamma), 0)) OVER (PARTITION BY scenario_id, date ORDER BY nu DESC) AS upto FROM sl),
nus AS (SELECT scenario_id, date, max(nu - (1 - (upto - gain)) * 2 * gamma / slope) AS nu FROM ms
        WHERE slope > 0 AND upto >= 1 AND upto - gain < 1 GROUP BY 1, 2),
hi AS (SELECT scenario_id, date, sum(ub) AS hi FROM nb GROUP BY 1, 2)
"""


@query(with_panel("""
SELECT b.scenario_id, b.date, b.code, CASE WHEN h.hi >= 1 - 1e-9 THEN 'optimal' ELSE 'infeasible' END AS status_code,
  round(CASE WHEN h.hi >= 1 - 1e-9 THEN least(greatest(ref + (alpha - n.nu) / (2 * gamma), lb), ub) ELSE 0.0 END, 6) AS weight
FROM nb b JOIN hi h ON h.scenario_id = b.scenario_id AND h.date = b.date
LEFT JOIN nus n ON n.scenario_id = b.scenario_id AND n.date = b.date""", FIRST))
def rebalance_job_first_period(spark, sf):
    panel, days, n = stored(spark, sf)
    alpha = proxy_risk.alpha(panel, days, n)
    weights, _ = rebalance.run_rebalance(panel, days, alpha, SCENARIOS, "hs300", every=6, carry=False, max_rows=n)
    return rounded(weights.select("scenario_id", "date", "code", "status_code", "weight"), "weight")


STEPS = 14  # dates of every sixth month of the proxy panel


def _carried_sql() -> str:
    """One set of tables per date; w{k} are the weights of date k, l{k} what each scenario goes on from."""
    ctes = [
        NAMES.replace("d.day % 6 = 4", "d.day % 6 = 0").rstrip(),
        """
sn AS (SELECT * FROM (VALUES ('enhanced', true, 0.2::DOUBLE, 10.0::DOUBLE, 0.02::DOUBLE), ('long_only', false, 0.2, 8.0, 0.0),
                      ('too_tight', false, 0.002, 0.05, 0.0)) t(scenario_id, enh, cap, gamma, tp))""",
        "slot AS (SELECT date, day // 6 AS k FROM days WHERE day % 6 = 0)",
        "l0 AS (SELECT '' AS scenario_id, '' AS code, 0.0::DOUBLE AS weight WHERE false)",
    ]
    for k in range(STEPS):
        ctes.append(f"""
x{k} AS MATERIALIZED (
  SELECT n.*, s.*, CASE WHEN s.scenario_id IN (SELECT scenario_id FROM l{k}) THEN coalesce(l.weight, 0.0) END AS p0
  FROM names n JOIN slot ON slot.date = n.date AND slot.k = {k} CROSS JOIN sn s LEFT JOIN l{k} l ON l.scenario_id = s.scenario_id AND l.code = n.code),
y{k} AS (
  SELECT scenario_id, date, code, gamma, CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 ELSE alpha0 END AS alpha,
    CASE WHEN enh THEN bm_weight ELSE 0.0 END AS ref, prev, CASE WHEN prev IS NULL THEN 0.0 ELSE tp * greatest(coalesce(cost, 1.0), 0.0) / (2 * gamma) END AS t,
    CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 WHEN status = 'limit_down' THEN coalesce(prev, 0.0) ELSE 0.0 END AS lb,
    CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 WHEN status = 'limit_up' THEN least(cap, coalesce(prev, cap)) ELSE cap END AS ub
  FROM (SELECT *, CASE WHEN sum(p0) OVER g > 1e-8 THEN p0 / sum(p0) OVER g ELSE p0 END AS prev FROM x{k} WINDOW g AS (PARTITION BY scenario_id))),
z{k} AS MATERIALIZED (SELECT *, coalesce(least(greatest(prev, lb), ub), lb) AS pc FROM y{k}),
b{k} AS (
  SELECT scenario_id, gamma, nu, sum(step) AS step FROM (
    SELECT scenario_id, gamma, unnest([alpha - 2 * gamma * (lb - t - ref), alpha - 2 * gamma * (pc - t - ref), alpha - 2 * gamma * (pc + t - ref),
      alpha - 2 * gamma * (ub + t - ref)]) AS nu, unnest([1, -1, 1, -1]) AS step FROM z{k}) GROUP BY ALL),
c{k} AS (SELECT scenario_id, sum(lb) AS lo, sum(ub) AS hi, count(*) FILTER (WHERE lb > ub) AS crossed FROM z{k} GROUP BY 1),
d{k} AS (SELECT *, sum(step) OVER o AS slope, lead(nu) OVER o AS nxt FROM b{k} WINDOW o AS (PARTITION BY scenario_id ORDER BY nu DESC)),
e{k} AS (SELECT d.*, coalesce(slope * (nu - nxt) / (2 * gamma), 0) AS gain, lo + sum(coalesce(slope * (nu - nxt) / (2 * gamma), 0)) OVER (
  PARTITION BY scenario_id ORDER BY nu DESC) AS upto FROM d{k} d JOIN c{k} USING (scenario_id)),
f{k} AS (SELECT scenario_id, max(nu - (1 - (upto - gain)) * 2 * gamma / slope) AS price FROM e{k} WHERE slope > 0 AND upto >= 1 AND upto - gain < 1 GROUP BY 1),
g{k} AS MATERIALIZED (
  SELECT scenario_id, date, code, crossed = 0 AND lo <= 1 + 1e-9 AND hi >= 1 - 1e-9 AS fine, least(greatest(CASE WHEN prev IS NULL THEN u WHEN u > prev + t THEN u - t
      WHEN u < prev - t THEN u + t ELSE prev END, lb), ub) AS weight
  FROM (SELECT z.*, lo, hi, crossed, ref + (alpha - price) / (2 * gamma) AS u FROM z{k} z JOIN c{k} USING (scenario_id) LEFT JOIN f{k} USING (scenario_id))),
w{k} AS (
  SELECT g.scenario_id, g.date, g.code, CASE WHEN fine THEN 'optimal' ELSE 'infeasible' END AS status_code, CASE WHEN fine THEN g.weight ELSE coalesce(l.weight, 0.0) END AS weight
  FROM g{k} g LEFT JOIN l{k} l ON l.scenario_id = g.scenario_id AND l.code = g.code WHERE fine OR g.scenario_id IN (SELECT scenario_id FROM l{k})),
l{k + 1} AS MATERIALIZED (
  SELECT scenario_id, code, weight FROM g{k} WHERE fine
  UNION ALL SELECT * FROM l{k} WHERE scenario_id NOT IN (SELECT scenario_id FROM g{k} WHERE fine))""")
    return ",".join(ctes) + "\n"


_CARRIED = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(STEPS))


@query(with_panel(f"SELECT scenario_id, date, code, status_code, round(weight, 6) AS weight FROM ({_CARRIED})", _carried_sql()))
def rebalance_job_carried(spark, sf):
    panel, days, n = stored(spark, sf)
    alpha = proxy_risk.alpha(panel, days, n)
    weights, _ = rebalance.run_rebalance(panel, days, alpha, SCENARIOS, "hs300", every=6, carry=True, max_rows=n)
    return rounded(weights.select("scenario_id", "date", "code", "status_code", "weight"), "weight")
