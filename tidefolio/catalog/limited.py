"""Weights under limits on industries and on the whole portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefolio.catalog.allocation import NAMES
from tidefolio.catalog.base import rounded, with_panel
from tidefolio.catalog.registry import query
from tidefolio.operators import allocate as al, bounds as bd, limits as lm
from tidefolio.plans import proxy_names
from tidefolio.session import cut_lineage

KEYS = ["scenario_id", "date"]
SCENARIOS = [
    bd.scenario("members", "index_enhance", weight_upper=0.2, industry_active_bound=0.03, min_constituent_ratio=0.95, max_turnover=None),
    bd.scenario("turnover", "index_enhance", weight_upper=0.2, industry_active_bound=0.05, min_constituent_ratio=0.0, max_turnover=0.9, turnover_penalty=0.02),
    bd.scenario("ball", "index_enhance", weight_upper=0.2, industry_active_bound=0.05, min_constituent_ratio=0.0, max_turnover=None, weight_diff_l2_bound=0.08),
    bd.scenario("industries", "alpha_max", weight_upper=0.2, penalty=8.0, industry_upper=0.01),
]
# the same in SQL: every industry's weight at every price where it bends, cut off at its limits
LIMITED = NAMES.rstrip() + """,
sn AS (SELECT * FROM (VALUES ('members', true, 10.0::DOUBLE, 0.0::DOUBLE, 0.03::DOUBLE, NULL::DOUBLE), ('turnover', true, 10.0, 0.02, 0.05, NULL),
                      ('ball', true, 10.0, 0.0, 0.05, NULL), ('industries', false, 8.0, 0.0, NULL, 0.01)) t(scenario_id, enh, gamma, tp, iab, iu)),
nb0 AS (
  SELECT scenario_id, enh, gamma, iab, iu, date, code, industry, is_constituent, bm_weight, prev_weight,
    CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 ELSE alpha0 END AS alpha,
    CASE WHEN enh THEN bm_weight ELSE 0.0 END AS ref, tp * greatest(coalesce(cost, 1.0), 0.0) / (2 * gamma) AS t,
    CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 WHEN status = 'limit_down' THEN prev_weight ELSE 0.0 END AS lb,
    CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 WHEN status = 'limit_up' THEN least(0.2, prev_weight) ELSE 0.2 END AS ub
  FROM names, sn),
nb AS (SELECT *, least(greatest(prev_weight, lb), ub) AS pc FROM nb0),
side AS (
  SELECT scenario_id, date, industry, sum(lb) AS lo, sum(ub) AS hi, count(*) FILTER (WHERE lb > ub) AS crossed,
    greatest(sum(lb), CASE WHEN any_value(enh) THEN sum(bm_weight) - any_value(iab) ELSE sum(lb) END) AS low,
    least(sum(ub), CASE WHEN any_value(enh) THEN sum(bm_weight) + any_value(iab) ELSE any_value(iu) END) AS high FROM nb GROUP BY 1, 2, 3),
state AS (
  SELECT scenario_id, date, CASE WHEN sum(crossed) = 0 AND bool_and(low <= high + 1e-9) AND sum(low) <= 1 + 1e-9 AND sum(high) >= 1 - 1e-9
    THEN 'optimal' ELSE 'infeasible' END AS status_code FROM side GROUP BY 1, 2),
bend AS (
  SELECT DISTINCT scenario_id, date, industry, unnest([alpha - 2 * gamma * (lb - t - ref), alpha - 2 * gamma * (pc - t - ref),
    alpha - 2 * gamma * (pc + t - ref), alpha - 2 * gamma * (ub + t - ref)]) AS nu FROM nb),
level AS (
  SELECT e.scenario_id, e.date, e.industry, e.nu, sum(least(greatest(
      CASE WHEN u - pr > t THEN u - t WHEN u - pr < -t THEN u + t ELSE pr END, lb), ub)) AS w
  FROM (SELECT b.scenario_id, b.date, b.industry, b.nu, n.t, n.lb, n.ub, n.prev_weight AS pr, n.ref + (n.alpha - b.nu) / (2 * n.gamma) AS u
        FROM bend b JOIN nb n ON n.scenario_id = b.scenario_id AND n.date = b.date AND n.industry = b.industry) e GROUP BY 1, 2, 3, 4),
piece AS (SELECT *, lead(nu) OVER k AS nu2, lead(w) OVER k AS w2 FROM level WINDOW k AS (PARTITION BY scenario_id, date, industry ORDER BY nu DESC)),
fixed AS (
  SELECT s.scenario_id, s.date, s.industry, s.low, s.high, s.lo, s.hi,
    CASE WHEN s.low > s.lo THEN min(p.nu + (p.nu2 - p.nu) * (s.low - p.w) / (p.w2 - p.w)) FILTER (WHERE p.w <= s.low AND s.low <= p.w2 AND p.w2 > p.w) END AS nu_low,
    CASE WHEN s.high < s.hi THEN max(p.nu + (p.nu2 - p.nu) * (s.high - p.w) / (p.w2 - p.w)) FILTER (WHERE p.w <= s.high AND s.high <= p.w2 AND p.w2 > p.w) END AS nu_high
  FROM side s LEFT JOIN piece p ON p.scenario_id = s.scenario_id AND p.date = s.date AND p.industry = s.industry GROUP BY s.scenario_id, s.date, s.industry, s.low, s.high, s.lo, s.hi),
kink AS (
  SELECT scenario_id, date, nu FROM bend UNION SELECT scenario_id, date, nu_low FROM fixed WHERE nu_low IS NOT NULL
  UNION SELECT scenario_id, date, nu_high FROM fixed WHERE nu_high IS NOT NULL),
cutoff AS (
  SELECT k.scenario_id, k.date, k.nu, n.industry, sum(least(greatest(CASE WHEN n.ref + (n.alpha - k.nu) / (2 * n.gamma) - n.prev_weight > n.t
      THEN n.ref + (n.alpha - k.nu) / (2 * n.gamma) - n.t WHEN n.ref + (n.alpha - k.nu) / (2 * n.gamma) - n.prev_weight < -n.t
      THEN n.ref + (n.alpha - k.nu) / (2 * n.gamma) + n.t ELSE n.prev_weight END, lb), ub)) AS w
  FROM kink k JOIN nb n ON n.scenario_id = k.scenario_id AND n.date = k.date GROUP BY 1, 2, 3, 4),
total AS (
  SELECT c.scenario_id, c.date, c.nu, sum(least(greatest(c.w, f.low), f.high)) AS w
  FROM cutoff c JOIN fixed f ON f.scenario_id = c.scenario_id AND f.date = c.date AND f.industry = c.industry GROUP BY 1, 2, 3),
stretch AS (SELECT *, lead(nu) OVER k AS nu2, lead(w) OVER k AS w2 FROM total WINDOW k AS (PARTITION BY scenario_id, date ORDER BY nu DESC)),
star AS (SELECT scenario_id, date, max(nu + (nu2 - nu) * (1 - w) / (w2 - w)) AS nu FROM stretch WHERE w <= 1 AND w2 >= 1 AND w2 > w GROUP BY 1, 2),
own AS (
  SELECT n.*, s.status_code, greatest(least(x.nu, f.nu_low), f.nu_high) AS nu FROM nb n
  JOIN state s ON s.scenario_id = n.scenario_id AND s.date = n.date LEFT JOIN star x ON x.scenario_id = n.scenario_id AND x.date = n.date
  LEFT JOIN fixed f ON f.scenario_id = n.scenario_id AND f.date = n.date AND f.industry = n.industry),
iw AS (
  SELECT *, CASE WHEN status_code = 'optimal' THEN least(greatest(CASE WHEN ref + (alpha - nu) / (2 * gamma) - prev_weight > t THEN ref + (alpha - nu) / (2 * gamma) - t
      WHEN ref + (alpha - nu) / (2 * gamma) - prev_weight < -t THEN ref + (alpha - nu) / (2 * gamma) + t ELSE prev_weight END, lb), ub) ELSE 0.0 END AS weight FROM own)
"""


def _inputs(spark, sf):
    names, _, _, n = proxy_names.names(spark, sf, once=True)
    rows = cut_lineage(al.allocation_inputs(bd.tradable_alpha(bd.name_bounds(bd.with_scenarios(names, SCENARIOS)))))
    return rows, bd.group_bounds(rows), n


@query(with_panel("SELECT scenario_id, date, code, status_code, round(weight, 6) AS weight FROM iw", LIMITED))
def industry_limited_weights(spark, sf):
    rows, limits, n = _inputs(spark, sf)
    out = lm.allocate_industries(rows, limits, max_rows=n)
    return rounded(out.select(*KEYS, "code", "status_code", "weight"), "weight")


# A limit that the weights without it keep has no price and leaves them as they are; one that they break has a
# price and holds with equality. Both follow from those weights, without the search. Turnover is at least the
# distance of the sums, so previous weights of zero cannot be turned over by less than all.
@query(with_panel("""
SELECT scenario_id, date, state AS status_code, CASE WHEN kind = 'constituent' AND members = 0 THEN NULL ELSE kind END AS kind,
  active AND state = 'optimal' AS active,
  round(CASE WHEN kind = 'constituent' AND members = 0 THEN NULL WHEN state = 'infeasible' THEN unheld WHEN active THEN bound ELSE value END, 5) AS value,
  0.0::DOUBLE AS industry_excess, round(CASE WHEN state = 'optimal' THEN total ELSE 0.0 END, 6) AS total
FROM (SELECT *, CASE WHEN kind = 'constituent' THEN members > 0 AND value < bound - 1e-6 ELSE value > bound + 1e-6 END AS active,
    CASE WHEN kind = 'turnover' AND apart > bound THEN 'infeasible' ELSE status_code END AS state FROM (
  SELECT scenario_id, date, any_value(status_code) AS status_code, sum(weight) AS total, count(*) FILTER (WHERE is_constituent) AS members,
    abs(1 - sum(prev_weight)) AS apart,
    CASE scenario_id WHEN 'members' THEN 'constituent' WHEN 'turnover' THEN 'turnover' ELSE 'deviation' END AS kind,
    CASE scenario_id WHEN 'members' THEN 0.95 WHEN 'turnover' THEN 0.9 ELSE 0.08 END AS bound,
    CASE scenario_id WHEN 'members' THEN 0.0 WHEN 'turnover' THEN sum(prev_weight) ELSE sqrt(sum(ref * ref)) END AS unheld,
    CASE scenario_id WHEN 'members' THEN sum(CASE WHEN is_constituent THEN weight ELSE 0 END) WHEN 'turnover' THEN sum(abs(weight - prev_weight))
      ELSE sqrt(sum((weight - ref) * (weight - ref))) END AS value
  FROM iw WHERE scenario_id <> 'industries' GROUP BY 1, 2))
UNION ALL SELECT scenario_id, date, 'infeasible', NULL, false, NULL, 0.0, 0.0 FROM state WHERE scenario_id = 'industries'""", LIMITED))
def coupled_weights(spark, sf):
    rows, limits, n = _inputs(spark, sf)
    weights = lm.allocate_limited(rows, limits, max_rows=n)
    whole = limits.where(F.col("kind").isin(*lm.WHOLE)).select(*KEYS, F.col("kind").alias("_kind"))
    sums = lm.portfolio_sums(weights, KEYS).unpivot(KEYS, list(lm.WHOLE), "_kind", "value").join(whole, [*KEYS, "_kind"])
    industry = weights.groupBy(*KEYS, F.col("industry").alias("key")).agg(F.sum("weight").alias("_w"))
    held = limits.where("kind = 'industry'").join(industry, [*KEYS, "key"])
    over = F.greatest(F.coalesce(F.col("_w") - F.col("hi"), F.lit(0.0)), F.coalesce(F.col("lo") - F.col("_w"), F.lit(0.0)))
    met = held.groupBy(*KEYS).agg(F.max(over).alias("over"))
    states = weights.groupBy(*KEYS).agg(
        F.first("status_code").alias("status_code"), F.coalesce(F.max("limit_price"), F.lit(0.0)).alias("limit_price"), F.sum("weight").alias("total")
    )
    out = states.join(sums, KEYS, "left").join(met, KEYS).select(
        *KEYS, "status_code", F.col("_kind").alias("kind"), (F.col("limit_price") > 0).alias("active"), "value",
        F.when(F.col("status_code") == al.OPTIMAL, F.greatest("over", F.lit(0.0))).otherwise(0.0).alias("industry_excess"), "total",
    )
    return rounded(rounded(out, "industry_excess", "total"), "value", places=5)
