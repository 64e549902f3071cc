"""Bounds, weights and their measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefolio.catalog.base import STATUS, rounded, with_panel
from tidefolio.catalog.benchmark import CARRIED, RETURNS
from tidefolio.catalog.registry import query
from tidefolio.catalog.risk import RISK
from tidefolio.catalog.series import cost_sql
from tidefolio.operators import allocate as al, audit as au, bounds as bd, risk
from tidefolio.plans import proxy_names, proxy_risk
from tidefolio.session import cut_lineage, new_table_path
from tidefolio.sources import sinks

# date, code, status, industry, is_constituent, alpha, bm_weight, prev_weight, cost
NAMES = CARRIED.rstrip() + "," + RETURNS.rstrip() + "," + cost_sql("d.day % 6 = 4", "u.code NOT LIKE '%.BJ' AND u.is_st <> 1").rstrip() + f""",
al AS (
  SELECT date, code, (a - avg(a) OVER w) / stddev_samp(a) OVER w AS alpha FROM (
    SELECT p.date, p.code, -(close / pre_close - 1) AS a FROM panel p JOIN days d ON d.date = p.date
    WHERE d.day % 2 = 1 AND pre_close IS NOT NULL) WINDOW w AS (PARTITION BY date)),
uni AS (
  SELECT p.date, p.code, {STATUS} AS status, industry_l1 AS industry, is_hs300 = 1 AS is_constituent
  FROM panel p JOIN ct ON ct.date = p.date WHERE code NOT LIKE '%.BJ' AND is_st <> 1),
near AS (SELECT ct.date, max(b.date) AS bm_date, max(a.date) AS alpha_date FROM ct
  LEFT JOIN (SELECT DISTINCT date FROM bmw) b ON b.date <= ct.date
  LEFT JOIN (SELECT DISTINCT date FROM al) a ON a.date <= ct.date GROUP BY 1),
names0 AS (
  SELECT u.*, coalesce(a.alpha, 0.0) AS alpha0, coalesce(b.bm_weight, 0.0) AS bm0, c.cost,
    CASE WHEN is_constituent AND status <> 'new_listing'
      THEN 1.0 / count(*) FILTER (WHERE is_constituent AND status <> 'new_listing') OVER (PARTITION BY u.date) ELSE 0.0 END AS prev_weight
  FROM uni u JOIN near n ON n.date = u.date AND n.bm_date IS NOT NULL
  LEFT JOIN al a ON a.date = n.alpha_date AND a.code = u.code
  LEFT JOIN bmw b ON b.date = n.bm_date AND b.code = u.code AND b.bm_weight > 0
  LEFT JOIN costs c ON c.date = u.date AND c.code = u.code),
names AS (
  SELECT *, CASE WHEN sum(bm0) OVER (PARTITION BY date) > 1e-8 THEN bm0 / sum(bm0) OVER (PARTITION BY date) ELSE bm0 END AS bm_weight
  FROM names0)
"""
SCENARIOS = [
    bd.scenario("enhanced", "index_enhance", weight_upper=0.2, turnover_penalty=0.02, industry_active_bound=0.07, min_constituent_ratio=0.6),
    bd.scenario("long_only", "alpha_max", weight_upper=0.2, penalty=8.0, industry_upper=0.3, style_bound={"Size": 0.4, "default": 1.0}),
    bd.scenario("too_tight", "alpha_max", weight_upper=0.002),
]
# the same scenarios for SQL; sn is joined to every name
SCALED = NAMES.rstrip() + """,
sn AS (SELECT * FROM (VALUES ('enhanced', true, 0.2::DOUBLE, 10.0::DOUBLE, 0.02::DOUBLE), ('long_only', false, 0.2, 8.0, 0.0),
                      ('too_tight', false, 0.002, 0.05, 0.0)) t(scenario_id, enh, cap, gamma, tp)),
nb AS (
  SELECT scenario_id, enh, gamma, date, code, status, industry, is_constituent, bm_weight, prev_weight,
    CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 ELSE alpha0 END AS alpha,
    CASE WHEN enh THEN bm_weight ELSE 0.0 END AS ref, tp * greatest(coalesce(cost, 1.0), 0.0) AS kappa,
    CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 WHEN status = 'limit_down' THEN prev_weight ELSE 0.0 END AS lb,
    CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 WHEN status = 'limit_up' THEN least(cap, prev_weight) ELSE cap END AS ub
  FROM names, sn),
bp0 AS (SELECT *, kappa / (2 * gamma) AS t, least(greatest(prev_weight, lb), ub) AS pc FROM nb),
bp AS (
  SELECT scenario_id, date, gamma, alpha - 2 * gamma * (lb - t - ref) AS nu, 1 AS step FROM bp0 UNION ALL
  SELECT scenario_id, date, gamma, alpha - 2 * gamma * (pc - t - ref), -1 FROM bp0 UNION ALL
  SELECT scenario_id, date, gamma, alpha - 2 * gamma * (pc + t - ref), 1 FROM bp0 UNION ALL
  SELECT scenario_id, date, gamma, alpha - 2 * gamma * (ub + t - ref), -1 FROM bp0),
bs AS (SELECT scenario_id, date, gamma, nu, sum(step) AS step FROM bp GROUP BY ALL),
sl AS (SELECT *, sum(step) OVER w AS slope, lead(nu) OVER w AS nxt FROM bs WINDOW w AS (PARTITION BY scenario_id, date ORDER BY nu DESC)),
sd AS (SELECT scenario_id, date, sum(lb) AS lo, sum(ub) AS hi, count(*) FILTER (WHERE lb > ub) AS crossed FROM nb GROUP BY 1, 2),
ms AS (SELECT sl.*, sd.lo, coalesce(slope * (nu - nxt) / (2 * gamma), 0) AS gain,
         sd.lo + sum(coalesce(slope * (nu - nxt) / (2 * gamma), 0)) OVER (PARTITION BY sl.scenario_id, sl.date ORDER BY nu DESC) AS upto
       FROM sl JOIN sd ON sd.scenario_id = sl.scenario_id AND sd.date = sl.date),
nus AS (SELECT scenario_id, date, max(nu - (1 - (upto - gain)) * 2 * gamma / slope) AS nu FROM ms
        WHERE slope > 0 AND upto >= 1 AND upto - gain < 1 GROUP BY 1, 2),
ww AS (
  SELECT b.*, CASE WHEN crossed = 0 AND lo <= 1 + 1e-9 AND hi >= 1 - 1e-9 THEN 'optimal' ELSE 'infeasible' END AS status_code,
    ref + (alpha - n.nu) / (2 * gamma) AS u
  FROM bp0 b JOIN sd ON sd.scenario_id = b.scenario_id AND sd.date = b.date
  LEFT JOIN nus n ON n.scenario_id = b.scenario_id AND n.date = b.date),
wt AS (
  SELECT *, CASE WHEN status_code = 'optimal' THEN least(greatest(
      CASE WHEN u > prev_weight + t THEN u - t WHEN u < prev_weight - t THEN u + t ELSE prev_weight END, lb), ub) ELSE 0.0 END AS weight
  FROM ww)
"""
# exposures and limits of the scenarios in SQL
KEYS = ["scenario_id", "date"]


def _inputs(spark, sf):
    names, panel, days, n = proxy_names.names(spark, sf, once=True)
    rows = bd.with_scenarios(names, SCENARIOS)
    return cut_lineage(al.allocation_inputs(bd.tradable_alpha(bd.name_bounds(rows)))), panel, days, n


def _weights(spark, sf):
    rows, panel, days, n = _inputs(spark, sf)
    return cut_lineage(al.allocate(rows, max_rows=n)), panel, days, n


@query(with_panel("SELECT date, code, status, industry, is_constituent, round(alpha0, 6) AS alpha, round(bm_weight, 6) AS bm_weight, round(prev_weight, 6) AS prev_weight, round(cost, 6) AS cost FROM names", NAMES))
def allocation_names(spark, sf):
    names, _, _, _ = proxy_names.names(spark, sf, once=True)
    cols = ["date", "code", "status", "industry", "is_constituent", "alpha", "bm_weight", "prev_weight", "cost"]
    return rounded(names.select(*cols), *cols[5:])


@query(with_panel("SELECT scenario_id, date, code, round(lb, 6) AS lb, round(ub, 6) AS ub, round(alpha, 6) AS alpha, round(ref, 6) AS ref, gamma, round(kappa, 6) AS kappa FROM nb", SCALED))
def name_bounds(spark, sf):
    rows, _, _, _ = _inputs(spark, sf)
    return rounded(rows.select(*KEYS, "code", "lb", "ub", "alpha", "ref", "gamma", "kappa"), "lb", "ub", "alpha", "ref", "kappa")


@query(with_panel("SELECT scenario_id, date, code, status_code, round(weight, 6) AS weight FROM wt", SCALED))
def optimal_weights(spark, sf):
    rows, _, _, n = _inputs(spark, sf)
    weights = al.allocate(rows, max_rows=n)  # read once, so not written
    return rounded(weights.select(*KEYS, "code", "status_code", "weight"), "weight")


@query(with_panel("""
SELECT scenario_id, date, count(*) FILTER (WHERE weight > 1e-6) AS positions, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest,
  round(sum(weight * weight), 6) AS hhi, round(sum(CASE WHEN is_constituent THEN weight ELSE 0 END), 6) AS member_weight,
  round(sum(abs(weight - bm_weight)), 6) AS active_l1, round(sqrt(sum((weight - bm_weight) * (weight - bm_weight))), 6) AS active_l2
FROM wt GROUP BY 1, 2""", SCALED))
def weight_concentration(spark, sf):
    weights, _, _, _ = _weights(spark, sf)
    return rounded(au.concentration(weights), "total", "largest", "hhi", "member_weight", "active_l1", "active_l2")


@query(with_panel("SELECT scenario_id, date, industry, round(sum(weight), 6) AS weight, round(sum(weight - bm_weight), 6) AS active FROM wt GROUP BY 1, 2, 3", SCALED))
def industry_weights(spark, sf):
    weights, _, _, _ = _weights(spark, sf)
    return rounded(au.industry_weights(weights), "weight", "active")


@query(with_panel("""
SELECT scenario_id, date, code, round(weight, 6) AS weight, round(weight * 100, 4) AS weight_pct, industry, is_constituent,
  round(bm_weight * 100, 4) AS bm_weight_pct, round((weight - bm_weight) * 100, 4) AS active_pct
FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, date ORDER BY round(weight, 9) DESC, code) AS rn FROM wt WHERE status_code = 'optimal')
WHERE rn <= 5""", SCALED))
def top_holdings(spark, sf):
    weights, _, _, _ = _weights(spark, sf)
    solid = weights.where(F.col("status_code") == "optimal").withColumn("weight", F.round("weight", 9))
    out = au.top_holdings(solid, 5)
    return rounded(rounded(out, "weight"), "weight_pct", "bm_weight_pct", "active_pct", places=4)


@query(with_panel("""
SELECT scenario_id, date, round(sum(alpha * weight), 6) AS alpha_term, round(sum(gamma * (weight - ref) * (weight - ref)), 6) AS penalty_term,
  round(sum(kappa * abs(weight - prev_weight)), 6) AS turnover_term,
  round(sum(alpha * weight) - sum(gamma * (weight - ref) * (weight - ref)) - sum(kappa * abs(weight - prev_weight)), 6) AS objective
FROM wt WHERE status_code = 'optimal' GROUP BY 1, 2""", SCALED))
def objective_terms(spark, sf):
    weights, _, _, _ = _weights(spark, sf)
    out = au.objective_value(weights.where(F.col("status_code") == "optimal"))
    return rounded(out, "alpha_term", "penalty_term", "turnover_term", "objective")


LIMITS = SCALED.rstrip() + """,
lim AS (
  SELECT scenario_id, date, 'industry' AS kind, industry AS key,
    CASE WHEN enh THEN sum(bm_weight) - 0.07 END AS lo,
    CASE WHEN enh THEN sum(bm_weight) + 0.07 WHEN scenario_id = 'long_only' THEN 0.3 ELSE 0.2 END AS hi FROM nb GROUP BY 1, 2, 4, enh
  UNION ALL
  SELECT scenario_id, date, 'constituent', 'members', 0.6, NULL FROM nb WHERE enh GROUP BY 1, 2 HAVING count(*) FILTER (WHERE is_constituent) > 0
  UNION ALL
  SELECT scenario_id, date, 'turnover', 'two_way', NULL, 0.2 FROM nb WHERE enh GROUP BY 1, 2),
val AS (
  SELECT scenario_id, date, 'industry' AS kind, industry AS key, sum(weight) AS value FROM wt GROUP BY 1, 2, 4
  UNION ALL SELECT scenario_id, date, 'constituent', 'members', sum(CASE WHEN is_constituent THEN weight ELSE 0 END) FROM wt GROUP BY 1, 2
  UNION ALL SELECT scenario_id, date, 'turnover', 'two_way', sum(abs(weight - prev_weight)) FROM wt GROUP BY 1, 2),
aud AS (
  SELECT l.*, v.value FROM lim l JOIN val v ON v.scenario_id = l.scenario_id AND v.date = l.date AND v.kind = l.kind AND v.key = l.key
  UNION ALL SELECT scenario_id, date, 'budget', 'all', 1.0, 1.0, sum(weight) FROM wt GROUP BY 1, 2
  UNION ALL SELECT scenario_id, date, 'names', 'all', 0.0, 0.0, max(greatest(weight - ub, lb - weight, 0.0)) FROM wt GROUP BY 1, 2
  UNION ALL SELECT scenario_id, date, 'banned', 'all', 0.0, 0.0, max(CASE WHEN status IN ('suspended', 'new_listing') THEN weight ELSE 0 END) FROM wt GROUP BY 1, 2)
"""


@query(with_panel("SELECT scenario_id, date, kind, key, round(lo, 6) AS lo, round(hi, 6) AS hi FROM lim", LIMITS))
def group_limits(spark, sf):
    rows, _, _, _ = _inputs(spark, sf)
    return rounded(bd.group_bounds(rows.withColumn("style_bounds", F.lit(None).cast("map<string,double>"))), "lo", "hi")


@query(with_panel("""
SELECT scenario_id, date, kind, key, round(value, 6) AS value, round(lo, 6) AS lo, round(hi, 6) AS hi,
  round(greatest(coalesce(value - hi, 0.0), coalesce(lo - value, 0.0), 0.0), 6) AS violation FROM aud""", LIMITS))
def constraint_audit(spark, sf):
    weights, _, _, _ = _weights(spark, sf)
    limits = bd.group_bounds(weights)
    return rounded(au.audit(weights, limits), "value", "lo", "hi", "violation")


STYLE_LIMITS = SCALED.rstrip() + "," + RISK[: RISK.index("ret1 AS")].rstrip() + """
rdn AS (SELECT w.date, max(r.rebal_date) AS rebal_date FROM (SELECT DISTINCT date FROM wt) w
  JOIN (SELECT DISTINCT rebal_date FROM expo) r ON r.rebal_date <= w.date GROUP BY 1),
se AS (SELECT w.scenario_id, w.date, e.factor AS key, sum(e.x * CASE WHEN enh THEN w.bm_weight ELSE 0 END) AS mid, sum(e.x * w.weight) AS value
  FROM wt w JOIN rdn r ON r.date = w.date JOIN expo e ON e.rebal_date = r.rebal_date AND e.code = w.code
  WHERE e.factor IN ('Size', 'Liquidity', 'Value') GROUP BY 1, 2, 3),
sb AS (SELECT *, CASE WHEN scenario_id = 'enhanced' THEN 0.3 WHEN scenario_id = 'long_only' AND key = 'Size' THEN 0.4 ELSE 1.0 END AS b FROM se),
sv AS (
  SELECT scenario_id, date, 'style' AS kind, key, value, mid - b AS lo, mid + b AS hi FROM sb UNION ALL
  SELECT scenario_id, date, 'deviation', 'l2', sqrt(sum((weight - bm_weight) * (weight - bm_weight))), NULL, 0.1 FROM wt GROUP BY 1, 2)
"""


@query(with_panel("""
SELECT scenario_id, date, kind, key, round(value, 6) AS value, round(lo, 6) AS lo, round(hi, 6) AS hi,
  round(greatest(coalesce(value - hi, 0.0), coalesce(lo - value, 0.0), 0.0), 6) AS violation FROM sv""", STYLE_LIMITS))
def style_and_deviation_audit(spark, sf):
    weights, panel, days, n = _weights(spark, sf)
    exposures = cut_lineage(proxy_risk.exposures(panel, days, n))
    known = exposures.select("rebal_date").distinct()
    dates = cut_lineage(risk.risk_dates(weights.select("date").distinct(), known))
    at = cut_lineage(risk.exposures_asof(weights.select("date", "code").distinct(), dates, exposures))
    limits = bd.group_bounds(weights.withColumn("weight_diff_l2_bound", F.lit(0.1)), at)
    rows = au.audit(weights, limits, at).where(F.col("kind").isin("style", "deviation"))
    return rounded(rows, "value", "lo", "hi", "violation")


@query(with_panel("""
SELECT date, code, round(CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0
    WHEN sd > 1e-10 THEN (c - mu) / sd ELSE c END, 6) AS alpha,
  round(0.05 * cost * CASE WHEN status IN ('suspended', 'new_listing') THEN 0.0 WHEN sd > 1e-10 THEN (c - mu) / sd ELSE c END, 6) AS return_alpha
FROM (SELECT *, avg(c) OVER (PARTITION BY date) AS mu, stddev_pop(c) OVER (PARTITION BY date) AS sd FROM (
  SELECT n.*, greatest(least(alpha0, q.hi), q.lo) AS c FROM names n JOIN (
    SELECT date, quantile_cont(alpha0, 0.01) AS lo, quantile_cont(alpha0, 0.99) AS hi FROM names GROUP BY 1) q ON q.date = n.date))""", NAMES))
def prepared_alpha(spark, sf):
    names, _, _, n = proxy_names.names(spark, sf)
    out = al.prepare_alpha(names, max_rows=n)
    scaled = al.return_alpha(F.col("alpha"), 0.05, F.col("cost"))
    return rounded(out.select("date", "code", "alpha", scaled.alias("return_alpha")), "alpha", "return_alpha")


TURN = SCALED.rstrip() + """,
rb AS (SELECT scenario_id, date, lag(date) OVER w AS pdate FROM (SELECT DISTINCT scenario_id, date FROM wt) WINDOW w AS (PARTITION BY scenario_id ORDER BY date)),
chg AS (
  SELECT r.scenario_id, r.date, a.code, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS d FROM rb r
    JOIN wt a ON a.scenario_id = r.scenario_id AND a.date = r.date
    LEFT JOIN wt b ON b.scenario_id = r.scenario_id AND b.date = r.pdate AND b.code = a.code
  UNION ALL
  SELECT r.scenario_id, r.date, b.code, -b.weight FROM rb r JOIN wt b ON b.scenario_id = r.scenario_id AND b.date = r.pdate
    WHERE NOT EXISTS (SELECT 1 FROM wt a WHERE a.scenario_id = r.scenario_id AND a.date = r.date AND a.code = b.code)),
tv AS (SELECT r.scenario_id, r.date, CASE WHEN r.pdate IS NOT NULL THEN sum(abs(d)) END AS turnover
  FROM rb r JOIN chg c ON c.scenario_id = r.scenario_id AND c.date = r.date GROUP BY 1, 2, r.pdate)
"""


@query(with_panel("SELECT scenario_id, date, round(turnover, 6) AS turnover FROM tv", TURN))
def rebalance_turnover(spark, sf):
    weights, _, _, _ = _weights(spark, sf)
    return rounded(au.turnover(weights), "turnover")


SUMMARY = with_panel("""
SELECT w.scenario_id, w.periods, f.failed, round(w.p, 6) AS mean_positions, round(t.m, 6) AS mean_turnover
FROM (SELECT scenario_id, count(*) AS periods, avg(n) AS p FROM (
        SELECT scenario_id, date, count(*) FILTER (WHERE weight > 1e-6) AS n FROM wt GROUP BY 1, 2) GROUP BY 1) w
JOIN (SELECT scenario_id, count(DISTINCT date) FILTER (WHERE status_code <> 'optimal') AS failed FROM wt GROUP BY 1) f ON f.scenario_id = w.scenario_id
JOIN (SELECT scenario_id, avg(coalesce(turnover, 0)) AS m FROM tv GROUP BY 1) t ON t.scenario_id = w.scenario_id""", TURN)


@query(SUMMARY)
def batch_summary(spark, sf):
    weights, _, _, _ = _weights(spark, sf)
    statuses = weights.select("scenario_id", "date", "status_code").distinct()
    return rounded(au.batch_summary(weights, statuses), "mean_positions", "mean_turnover")


@query(with_panel("SELECT scenario_id, date, code, round(weight, 6) AS weight FROM wt", SCALED))
def weights_store(spark, sf):
    weights, _, _, _ = _weights(spark, sf)
    path = new_table_path(spark, "weights")
    sinks.write_weights(weights.select("scenario_id", "date", "code", "weight"), path)
    return rounded(spark.read.parquet(path), "weight")


@query(SUMMARY)
def summary_store(spark, sf):
    weights, _, _, _ = _weights(spark, sf)
    summary = au.batch_summary(weights, weights.select("scenario_id", "date", "status_code").distinct())
    path = new_table_path(spark, "summary")
    sinks.write_summary(summary, path)
    stored = spark.read.schema(summary.schema).csv(path, header=True)
    return rounded(stored, "mean_positions", "mean_turnover")
