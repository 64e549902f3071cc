"""Risk panels and factor risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefolio.catalog.base import load, rounded, stored, with_panel
from tidefolio.catalog.registry import query
from tidefolio.operators import risk
from tidefolio.operators.groups import with_aggregates
from tidefolio.plans import proxy_risk
from tidefolio.session import cut_lineage, new_table_path
from tidefolio.sources import risk as risk_source

RISK = """
rd AS (SELECT date FROM days WHERE day >= 2 AND day % 2 = 0),
z AS (
  SELECT p.date AS rebal_date, code, trade_status, industry_l1,
         (ln(volume) - avg(ln(volume)) OVER w) / stddev_samp(ln(volume)) OVER w AS zs,
         (ln(amount) - avg(ln(amount)) OVER w) / stddev_samp(ln(amount)) OVER w AS zl,
         (vwap - avg(vwap) OVER w) / stddev_samp(vwap) OVER w AS zv
  FROM panel p WHERE p.date IN (SELECT date FROM rd) WINDOW w AS (PARTITION BY p.date)),
zu AS (SELECT * FROM z WHERE trade_status <> '停牌'),
expo AS (
  SELECT rebal_date, code, 'Size' AS factor, zs AS x FROM zu UNION ALL
  SELECT rebal_date, code, 'Liquidity', zl FROM zu UNION ALL
  SELECT rebal_date, code, 'Value', zv FROM zu UNION ALL
  SELECT rebal_date, code, 'Country', 1.0 FROM zu UNION ALL
  SELECT rebal_date, code, industry_l1, 1.0 FROM zu),
ret1 AS (
  SELECT p.date, p.code, p.adj_close / q.adj_close - 1 AS ret
  FROM panel p JOIN days d ON d.date = p.date LEFT JOIN days e ON e.day = d.day - 1
  LEFT JOIN panel q ON q.date = e.date AND q.code = p.code),
spec AS (
  SELECT date AS rebal_date, code, CASE WHEN n >= 3 THEN v END AS spec_var FROM (
    SELECT date, code, count(ret) OVER w AS n, var_samp(ret) OVER w AS v FROM ret1
    WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING))
  WHERE date IN (SELECT date FROM rd)),
half AS (
  SELECT rebal_date, 'Size' AS factor_i, 'Size' AS factor_j, covar_samp(zs, zs) * 0.001 AS cov FROM zu GROUP BY 1 UNION ALL
  SELECT rebal_date, 'Size', 'Liquidity', covar_samp(zs, zl) * 0.001 FROM zu GROUP BY 1 UNION ALL
  SELECT rebal_date, 'Size', 'Value', covar_samp(zs, zv) * 0.001 FROM zu GROUP BY 1 UNION ALL
  SELECT rebal_date, 'Liquidity', 'Liquidity', covar_samp(zl, zl) * 0.001 FROM zu GROUP BY 1 UNION ALL
  SELECT rebal_date, 'Liquidity', 'Value', covar_samp(zl, zv) * 0.001 FROM zu GROUP BY 1 UNION ALL
  SELECT rebal_date, 'Value', 'Value', covar_samp(zv, zv) * 0.001 FROM zu GROUP BY 1 UNION ALL
  SELECT DISTINCT rebal_date, 'Country', 'Country', 0.0004 FROM zu UNION ALL
  SELECT DISTINCT rebal_date, industry_l1, industry_l1, 0.0001 FROM zu),
cov AS (
  SELECT rebal_date, factor_i, factor_j, cov FROM half UNION ALL
  SELECT rebal_date, factor_j, factor_i, cov FROM half WHERE factor_i <> factor_j)
"""
# equal weights over hs300 members minus equal weights over all, on risk-covered dates
ACTIVE = RISK.rstrip() + """,
near AS (SELECT d.date, max(r.rebal_date) AS rebal_date FROM days d JOIN (SELECT DISTINCT rebal_date FROM half) r
         ON r.rebal_date <= d.date WHERE d.day % 3 = 1 GROUP BY 1),
hold AS (
  SELECT p.date, p.code, n.rebal_date,
         coalesce(is_hs300 / nullif(sum(is_hs300) OVER (PARTITION BY p.date), 0), 0) - 1.0 / count(*) OVER (PARTITION BY p.date) AS w
  FROM panel p JOIN near n ON n.date = p.date),
ex AS (
  SELECT h.date, h.rebal_date, e.factor, sum(e.x * h.w) AS exposure
  FROM hold h JOIN expo e ON e.rebal_date = h.rebal_date AND e.code = h.code GROUP BY 1, 2, 3)
"""


@query(with_panel("SELECT rebal_date, code, factor, round(x, 6) AS x FROM expo", RISK))
def risk_exposures(spark, sf):
    panel, days, n = load(spark, sf)
    return rounded(proxy_risk.exposures(panel, days, n), "x")


@query(with_panel("SELECT rebal_date, factor_i, factor_j, round(cov, 8) AS cov FROM cov", RISK))
def risk_covariance(spark, sf):
    panel, days, n = load(spark, sf)
    cov = proxy_risk.covariance(cut_lineage(proxy_risk.exposures(panel, days, n)))
    mirrored = risk.mirror_covariance(cov)
    return rounded(risk.symmetric_covariance(mirrored), "cov", places=8)


@query(with_panel("""
SELECT u.rebal_date, u.code, round(coalesce(s.spec_var, m.mid), 6) AS spec_var
FROM zu u JOIN spec s ON s.rebal_date = u.rebal_date AND s.code = u.code
JOIN (SELECT u2.rebal_date, median(s2.spec_var) AS mid FROM zu u2
      JOIN spec s2 ON s2.rebal_date = u2.rebal_date AND s2.code = u2.code GROUP BY 1) m ON m.rebal_date = u.rebal_date""", RISK))
def specific_variance_filled(spark, sf):
    panel, days, n = load(spark, sf)
    names = proxy_risk.exposures(panel, days, n).select("rebal_date", "code").distinct()
    out = risk.fill_specific(names, proxy_risk.specific(panel, days), max_rows=n)
    return rounded(out, "spec_var")


@query(with_panel("""
SELECT rebal_date, code, round(zs, 6) AS Size, round(zl, 6) AS Liquidity, round(zv, 6) AS Value, 1.0::DOUBLE AS Country,
  CASE WHEN industry_l1 = 'NATION_4' THEN 1.0 ELSE 0.0 END::DOUBLE AS NATION_4 FROM zu""", RISK))
def risk_exposures_wide(spark, sf):
    panel, days, n = load(spark, sf)
    out = risk.wide_exposures(proxy_risk.exposures(panel, days, n), ["Size", "Liquidity", "Value", "Country", "NATION_4"])
    return rounded(out, "Size", "Liquidity", "Value")


def _model(spark, sf):
    """Tables read more than once are written once, as a stored risk model is."""
    panel, days, n = stored(spark, sf)
    exposures = cut_lineage(proxy_risk.exposures(panel, days, n))
    cov = cut_lineage(risk.mirror_covariance(proxy_risk.covariance(exposures)))
    dates = cut_lineage(risk.risk_dates(days.where(F.col("day") % 3 == 1).select("date"), cov))
    sizes = {"_all": F.count(F.lit(1)), "_members": F.sum("is_hs300")}
    covered = panel.join(F.broadcast(dates), "date", "left_semi")
    held = with_aggregates(covered, ["date"], sizes, n).select(
        "date", "code",
        (F.coalesce(F.try_divide("is_hs300", "_members"), F.lit(0.0)) - 1.0 / F.col("_all")).alias("weight"),
    )
    return panel, days, n, exposures, cov, dates, held


@query(with_panel("SELECT date, factor, round(exposure, 6) AS exposure, factor IN ('Size', 'Liquidity', 'Value') AS style FROM ex", ACTIVE))
def factor_exposures(spark, sf):
    _, _, _, exposures, _, dates, held = _model(spark, sf)
    at = risk.exposures_asof(held, dates, exposures)
    return rounded(risk.factor_exposure(held, at), "exposure").withColumn("style", risk.is_style())


@query(with_panel("""
SELECT coalesce(d.date, e.date) AS date, round(coalesce(fr, 0), 8) AS factor_risk, round(coalesce(sr, 0), 8) AS specific_risk,
  round(coalesce(fr, 0) + coalesce(sr, 0), 8) AS total_risk
FROM (SELECT a.date, sum(a.exposure * c.cov * b.exposure) AS fr
      FROM ex a JOIN cov c ON c.rebal_date = a.rebal_date AND c.factor_i = a.factor
      JOIN ex b ON b.date = a.date AND b.factor = c.factor_j GROUP BY 1) d
FULL JOIN (SELECT h.date, sum(h.w * h.w * coalesce(s.spec_var, m.mid)) AS sr
      FROM hold h LEFT JOIN spec s ON s.rebal_date = h.rebal_date AND s.code = h.code
      JOIN (SELECT rebal_date, median(spec_var) AS mid FROM spec GROUP BY 1) m ON m.rebal_date = h.rebal_date
      GROUP BY 1) e ON e.date = d.date""", ACTIVE))
def factor_risk_decomposition(spark, sf):
    panel, days, n, exposures, cov, dates, held = _model(spark, sf)
    at = risk.exposures_asof(held, dates, exposures)
    own = risk.specific_asof(held, dates, proxy_risk.specific(panel, days), max_rows=n)
    out = risk.risk_decomposition(held, at, own, cov, dates)
    return rounded(out, "factor_risk", "specific_risk", "total_risk", places=8)


@query(with_panel("""
SELECT v AS variant, t.* FROM (VALUES ('S'), ('L')) w(v), (
  SELECT 'exposure' AS kind, rebal_date, code AS a, factor AS b, round(x, 6) AS value FROM expo UNION ALL
  SELECT 'specific', u.rebal_date, u.code, '', round(coalesce(s.spec_var, m.mid), 6)
  FROM zu u JOIN spec s ON s.rebal_date = u.rebal_date AND s.code = u.code
  JOIN (SELECT u2.rebal_date, median(s2.spec_var) AS mid FROM zu u2
        JOIN spec s2 ON s2.rebal_date = u2.rebal_date AND s2.code = u2.code GROUP BY 1) m ON m.rebal_date = u.rebal_date UNION ALL
  SELECT 'covariance', rebal_date, factor_i, factor_j, round(cov, 6) FROM cov) t""", RISK))
def risk_panels_stored(spark, sf):
    panel, days, n = stored(spark, sf)
    exposures = cut_lineage(proxy_risk.exposures(panel, days, n))
    names = exposures.select("rebal_date", "code").distinct()
    filled = risk.fill_specific(names, proxy_risk.specific(panel, days), max_rows=n)
    cov = risk.mirror_covariance(proxy_risk.covariance(exposures))
    variants = F.explode(F.array(F.lit("S"), F.lit("L"))).alias("variant")
    path = new_table_path(spark, "risk")
    risk_source.write_risk_panels(*(df.select("*", variants) for df in (exposures, filled, cov)), path)
    out = None
    for v in ("S", "L"):
        e, s, c = risk_source.load_risk_panels(spark, path, v)
        parts = (("exposure", e, "code", "factor", "x"), ("specific", s, "code", None, "spec_var"), ("covariance", c, "factor_i", "factor_j", "cov"))
        for kind, df, a, b, value in parts:
            one = df.select(
                F.lit(v).alias("variant"), F.lit(kind).alias("kind"), "rebal_date", F.col(a).alias("a"),
                (F.col(b) if b else F.lit("")).alias("b"), F.col(value).alias("value"),
            )
            out = one if out is None else out.unionByName(one)
    return rounded(out, "value")
