"""The proxy panel in SQL, and small helpers of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidefolio.plans.proxy import load, stored  # noqa: F401

# The panel that plans/proxy.py builds, written for the SQL engine.
PANEL = """
cells AS (
  SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         sum(l_quantity) AS qty,
         coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0.0) AS qty_n,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cents,
         max(l_extendedprice / l_quantity) AS close,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS discount,
         count(*) AS lines
  FROM lineitem GROUP BY 1, 2),
firsts AS (SELECT l_suppkey AS fk, min(date) AS first_date FROM cells GROUP BY 1),
priced AS (
  SELECT c.*, f.first_date, p.close AS pre_close
  FROM cells c JOIN firsts f ON f.fk = c.l_suppkey
  LEFT JOIN cells p ON p.l_suppkey = c.l_suppkey AND p.date = CAST(c.date - INTERVAL 1 MONTH AS DATE)),
panel AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0')
           || CASE l_suppkey % 10 WHEN 0 THEN '.BJ' ELSE '.SZ' END AS code,
         date, s_name AS name, pre_close, close,
         pre_close * 1.1 AS limit_up, pre_close * 0.9 AS limit_down,
         qty AS volume, cents / 100000.0 AS amount,
         close AS adj_close, cents / 100.0 / qty AS adj_vwap, 1.0::DOUBLE AS adj_factor,
         CASE WHEN lines <= 2 THEN '停牌' ELSE '交易' END AS trade_status,
         cents / 100.0 / qty AS vwap,
         qty * 10.0::DOUBLE AS total_mv, qty * 10.0::DOUBLE * (1.0 - discount) AS float_mv,
         qty * 10.0::DOUBLE * qty_n / qty AS free_mv,
         n_name AS industry_l1,
         strftime(first_date, '%Y%m%d') AS list_date,
         CAST(datediff('day', first_date, date) AS INTEGER) AS list_days,
         '20991231' AS delist_date,
         CASE WHEN l_suppkey % 3 = 0 AND month(date) <> 5 THEN 1 ELSE 0 END AS is_hs300,
         CASE WHEN l_suppkey % 3 = 1 THEN 1 ELSE 0 END AS is_zz500,
         CASE WHEN l_suppkey % 3 = 2 THEN 1 ELSE 0 END AS is_zz1000,
         CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS is_st
  FROM priced JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
days AS (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS day, lead(date) OVER (ORDER BY date) AS next_date
  FROM (SELECT DISTINCT date FROM panel))
"""

# Trading state of each row.
STATUS = """
CASE WHEN is_st = 1 THEN 'new_listing'
     WHEN list_days < 60 THEN 'new_listing'
     WHEN trade_status = '停牌' THEN 'suspended'
     WHEN trade_status = '交易' AND limit_down > 0 AND abs(close - limit_down) / limit_down < 0.0005 THEN 'limit_down'
     WHEN trade_status = '交易' AND limit_up > 0 AND abs(close - limit_up) / limit_up < 0.0005 THEN 'limit_up'
     ELSE 'normal' END
"""


def with_panel(body: str, ctes: str = "") -> str:
    """SQL over the proxy panel; ``ctes`` are further named tables."""
    more = f",\n{ctes.strip()}" if ctes.strip() else ""
    return f"WITH {PANEL.strip()}{more}\n{body.strip()}"


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})

