"""Sources, projections, universes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidefolio.catalog.base import STATUS, load, rounded, with_panel
from tidefolio.catalog.registry import query
from tidefolio.functions import fixed as K
from tidefolio.functions.cols import (
    bound_for,
    bounds_map,
    cannot_buy,
    cannot_sell,
    flexible_date,
)
from tidefolio.operators import calendar as cal, timeseries as ts, universe as uni
from tidefolio.plans import proxy
from tidefolio.session import new_table_path
from tidefolio.sources import alpha as alpha_source, index_close, panel as store

PANEL_COLS = [
    "code", "date", "name", "pre_close", "close", "limit_up", "limit_down", "volume", "amount",
    "adj_close", "adj_vwap", "adj_factor", "trade_status", "vwap", "total_mv", "float_mv", "free_mv",
    "industry_l1", "list_date", "list_days", "delist_date", "is_hs300", "is_zz500", "is_zz1000", "is_st",
]


@query(with_panel(f"SELECT {', '.join(PANEL_COLS)} FROM panel"))
def panel_rows(spark, sf):
    return proxy.panel(spark, sf).select(*PANEL_COLS)


def _stored(spark, sf) -> str:
    """The proxy panel written as a year-partitioned table."""
    raw = proxy.panel(spark, sf).withColumnRenamed("vwap", "avg_price").drop("adj_vwap", "list_days")
    path = new_table_path(spark, "panel")
    store.sync_panel(raw, path)
    return path


STORED_COLS = ["code", "date", "adj_close", "volume", "float_mv", "is_st", "trade_status", "industry_l1", "adj_vwap", "vwap", "adj_factor"]


@query(with_panel(f"""
SELECT {", ".join(STORED_COLS)} FROM panel WHERE date BETWEEN DATE '1996-03-01' AND DATE '1999-10-01'"""))
def panel_store_date_range(spark, sf):
    path = _stored(spark, sf)
    df = store.load_panel(spark, path, date(1996, 3, 1), date(1999, 10, 1), "signal_only", ordered=True)
    return df.select(*STORED_COLS)


@query(with_panel("""
SELECT year(date)::INTEGER AS year, count(*) AS n, count(DISTINCT code) AS codes, sum(list_days)::BIGINT AS list_days,
       count(free_mv) AS free_known, round(sum(adj_vwap), 4) AS adj_vwap, count(CASE WHEN false THEN 1 END) AS opens
FROM panel GROUP BY 1"""))
def panel_etl_by_year(spark, sf):
    stored = spark.read.parquet(_stored(spark, sf))
    return stored.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("code").alias("codes"),
        F.sum("list_days").alias("list_days"),
        F.count("free_mv").alias("free_known"),
        F.round(F.sum("adj_vwap"), 4).alias("adj_vwap"),
        F.count("open").alias("opens"),
    )


@query(with_panel("""
SELECT y::INTEGER AS year FROM range(1990, 2006) r(y) WHERE y NOT IN (SELECT DISTINCT year(date) FROM panel)"""))
def panel_missing_years(spark, sf):
    states = store.year_states(spark, _stored(spark, sf), date(1990, 1, 1), date(2005, 12, 31))
    return states.where(F.col("state").isin("absent", "empty")).select("year")


@query(with_panel("""
SELECT y::INTEGER AS year, count(p.date) AS rows, CASE WHEN count(p.date) = 0 THEN 'absent' ELSE 'present' END AS state
FROM range(1990, 2006) r(y) LEFT JOIN panel p ON year(p.date) = y AND p.code NOT LIKE '%.BJ' GROUP BY 1
UNION ALL SELECT NULL, count(*), 'undated' FROM panel WHERE code LIKE '%.BJ' HAVING count(*) > 0"""))
def panel_year_states(spark, sf):
    path = new_table_path(spark, "panel")
    dated = F.when(~F.col("code").endswith(".BJ"), F.col("date")).alias("date")
    store.write_panel(proxy.panel(spark, sf).select("code", dated, "close"), path)
    return store.year_states(spark, path, date(1990, 1, 1), date(2005, 12, 31)).drop("files")


@query("""
WITH d AS (SELECT l_linenumber AS ln, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_partkey, l_suppkey FROM lineitem)
SELECT ln, day, count(*) AS n FROM d GROUP BY 1, 2""")
def flexible_dates(spark, sf):
    d = F.col("l_shipdate").cast("date")
    text = (
        F.when(F.col("l_linenumber") % 5 == 0, F.date_format(d, "yyyyMMdd"))
        .when(F.col("l_linenumber") % 5 == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("l_linenumber") % 5 == 2, F.date_format(d, "yyyy/MM/dd"))
        .when(F.col("l_linenumber") % 5 == 3, F.col("l_shipdate").cast("string"))
        .otherwise(F.date_format(d, "yyyyMMdd").cast("int").cast("double").cast("long").cast("string"))
    )
    rows = proxy.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("ln"), flexible_date(text).alias("day"))
    return rows.groupBy("ln", "day").agg(F.count(F.lit(1)).alias("n"))


INDEX_NAMES = {
    "1-URGENT": "沪深300", "2-HIGH": "中证500", "3-MEDIUM": "中证1000", "4-NOT SPECIFIED": "中证全指", "5-LOW": "万得全A",
}
_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INDEX_NAMES.items()) + " END"
INDEX_SQL = f"""
closes AS (
  SELECT {_CASE} AS index_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS close
  FROM orders GROUP BY 1, 2)
"""


def index_file(spark, sf) -> str:
    """Monthly order value per priority, written as the wide index CSV."""
    names = F.create_map(*[F.lit(x) for kv in INDEX_NAMES.items() for x in kv])
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    wide = (
        proxy.table(spark, sf, "orders")
        .withColumn("index_name", names[F.col("o_orderpriority")])
        .groupBy(F.date_format(proxy.month_of("o_orderdate"), "yyyyMMdd").alias("date"))
        .pivot("index_name", [*INDEX_NAMES.values(), "中证红利"])
        .agg((F.sum(cents).cast("double") / 100.0))
    )
    path = new_table_path(spark, "index")
    wide.write.csv(path, header=True)
    return path


@query(f"WITH {INDEX_SQL} SELECT index_key, date, round(close, 2) AS close FROM closes WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-06-01' AND index_key = '中证1000'")
def index_closes(spark, sf):
    df = index_close.load_index_close(spark, "zz1000", index_file(spark, sf), "1996-01-01", "1998-06-01")
    return rounded(df, "close", places=2)


@query(f"WITH {INDEX_SQL} SELECT index_key, count(*) AS closes FROM closes GROUP BY 1")
def index_columns_available(spark, sf):
    return index_close.available_indices(spark, index_file(spark, sf))


@query(f"""
WITH {INDEX_SQL},
r AS (SELECT index_key, date, close / lag(close) OVER (PARTITION BY index_key ORDER BY date) - 1 AS ret FROM closes)
SELECT index_key, date, round(ret, 6) AS ret FROM r WHERE index_key = '沪深300' AND date >= DATE '1996-01-01' AND ret IS NOT NULL""")
def index_returns(spark, sf):
    df = index_close.load_index_returns(spark, "hs300", index_file(spark, sf), "1996-01-01")
    return rounded(df.select("index_key", "date", "ret"), "ret")


@query(with_panel("""
SELECT p.industry_l1 AS code, p.date, round(sum(amount), 6) AS alpha FROM panel p GROUP BY 1, 2"""))
def alpha_wide_to_long(spark, sf):
    names = [r[0] for r in proxy.table(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]
    wide = proxy.panel(spark, sf).groupBy("date").pivot("industry_l1", names).agg(F.sum("amount"))
    path = new_table_path(spark, "alpha")
    wide.write.parquet(path)
    return rounded(alpha_source.load_alpha(spark, path), "alpha")


@query(with_panel(f"SELECT date, code, {STATUS} AS status FROM panel"))
def trade_status(spark, sf):
    return uni.snapshot(proxy.panel(spark, sf), "hs300").select("date", "code", "status")


@query(with_panel("""
SELECT date, count(*) AS names, count(*) FILTER (WHERE status = 'suspended') AS suspended,
  count(*) FILTER (WHERE status = 'limit_up') AS limit_up, count(*) FILTER (WHERE status = 'limit_down') AS limit_down,
  count(*) FILTER (WHERE status = 'new_listing') AS new_listing, count(*) FILTER (WHERE status = 'normal') AS normal,
  count(*) FILTER (WHERE status NOT IN ('suspended', 'new_listing')) AS tradable,
  count(*) FILTER (WHERE is_hs300 = 1) AS members
FROM st GROUP BY 1""", f"st AS (SELECT *, {STATUS} AS status FROM panel)"))
def status_counts(spark, sf):
    snap = uni.status_masks(uni.snapshot(proxy.panel(spark, sf), "hs300"))
    tradable = snap.groupBy("date").agg(F.count_if("tradable").alias("tradable"))
    return uni.universe_counts(snap).join(tradable, "date")


@query(with_panel("""
SELECT date, code,
  coalesce(trade_status = '停牌', false) OR coalesce(close >= limit_up * 0.999, false) AS cant_buy,
  coalesce(trade_status = '停牌', false) OR coalesce(close <= limit_down * 1.001, false) AS cant_sell
FROM panel"""))
def tradability_flags(spark, sf):
    return proxy.panel(spark, sf).select(
        "date", "code", cannot_buy().alias("cant_buy"), cannot_sell().alias("cant_sell")
    )


@query(with_panel(f"""
SELECT date, code, status, round(market_cap, 2) AS market_cap, industry, is_constituent FROM (
  SELECT date, code, {STATUS} AS status, float_mv * 1e4 AS market_cap, industry_l1 AS industry,
         is_zz500 = 1 AS is_constituent,
         row_number() OVER (PARTITION BY date ORDER BY coalesce(float_mv * 1e4, 0) DESC, code) AS rn
  FROM panel WHERE code NOT LIKE '%.BJ' AND is_st <> 1) WHERE rn <= 30"""))
def universe_top_by_cap(spark, sf):
    snap = uni.filter_universe(uni.snapshot(proxy.panel(spark, sf), "zz500"), top_n=30)
    return rounded(snap.drop("is_st"), "market_cap", places=2)


ADV_SQL = """
valid AS (
  SELECT date, code, avg(amount) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a
  FROM panel WHERE trade_status <> '停牌' AND amount IS NOT NULL),
adv AS (
  SELECT p.date, p.code,
         coalesce(last_value(v.a IGNORE NULLS) OVER (PARTITION BY p.code ORDER BY p.date) * 1000, 1e5) AS adv
  FROM panel p LEFT JOIN valid v ON v.date = p.date AND v.code = p.code)
"""


@query(with_panel("SELECT date, code, round(adv, 6) AS adv FROM adv", ADV_SQL))
def average_daily_value(spark, sf):
    df = ts.average_daily_value(proxy.panel(spark, sf)).select("date", "code", "adv")
    return rounded(df, "adv")


@query(with_panel(f"""
SELECT date, code, is_constituent,
       round(CASE WHEN sum(pw) OVER (PARTITION BY date) > 1e-10 THEN pw / sum(pw) OVER (PARTITION BY date) ELSE pw END, 6) AS prev_weight
FROM picked""", ADV_SQL + f""",
st AS (SELECT p.date, p.code, a.adv, p.is_hs300 = 1 AS is_constituent, {STATUS} AS status
       FROM panel p JOIN adv a ON a.date = p.date AND a.code = p.code),
pw AS (SELECT *, CASE WHEN is_constituent AND status <> 'new_listing'
              THEN 1.0 / count(*) FILTER (WHERE is_constituent AND status <> 'new_listing') OVER (PARTITION BY date)
              ELSE 0 END AS pw FROM st),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date, is_constituent ORDER BY adv DESC, code) AS rn FROM pw),
picked AS (SELECT * FROM ranked WHERE is_constituent OR rn <= 10)"""))
def universe_members_plus(spark, sf):
    panel, _, n = load(spark, sf)
    snap = uni.default_prev_weights(uni.snapshot(ts.average_daily_value(panel), "hs300"), max_rows=n)
    out = uni.reduce_universe(snap, "constituent_plus", 10, max_rows=n)
    return rounded(out.select("date", "code", "is_constituent", "prev_weight"), "prev_weight")


@query(with_panel(f"""
SELECT date, code, round(CASE WHEN is_hs300 = 1 AND status <> 'new_listing'
         THEN 1.0 / count(*) FILTER (WHERE is_hs300 = 1 AND status <> 'new_listing') OVER (PARTITION BY date)
         ELSE 0 END, 6) AS prev_weight
FROM (SELECT *, {STATUS} AS status FROM panel)"""))
def default_previous_weights(spark, sf):
    panel, _, n = load(spark, sf)
    out = uni.default_prev_weights(uni.snapshot(panel, "hs300"), max_rows=n)
    return rounded(out.select("date", "code", "prev_weight"), "prev_weight")


@query(with_panel("SELECT date, count(*) AS n FROM panel WHERE is_hs300 = 1 OR is_zz500 = 1 OR is_zz1000 = 1 GROUP BY 1"))
def index_union_universe(spark, sf):
    return uni.index_union(proxy.panel(spark, sf)).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(with_panel("""
SELECT industry_l1 AS factor, (CASE WHEN industry_l1 = 'NATION_3' THEN 0.1 WHEN industry_l1 = 'NATION_7' THEN 0.2
       ELSE 0.5 END)::DOUBLE AS bound, (CASE WHEN industry_l1 = 'NATION_3' THEN 0.1 ELSE 1e6 END)::DOUBLE AS bound_open,
       0.3::DOUBLE AS bound_all, count(*) AS n
FROM panel GROUP BY 1, 2, 3"""))
def style_bounds(spark, sf):
    rows = proxy.panel(spark, sf).groupBy(F.col("industry_l1").alias("factor")).agg(F.count(F.lit(1)).alias("n"))
    f = F.col("factor")
    return rows.select(
        "factor",
        bound_for(bounds_map({"default": 0.5, "NATION_3": 0.1, "NATION_7": 0.2}), f).alias("bound"),
        bound_for(bounds_map({"NATION_3": 0.1}), f).alias("bound_open"),
        bound_for(bounds_map(0.3), f).alias("bound_all"),
        "n",
    )


@query(with_panel("""
SELECT code, date, count(*) AS n FROM panel WHERE code <> '689009.SH' AND date BETWEEN DATE '1997-01-01' AND DATE '1997-06-01'
  AND industry_l1 IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY 1, 2"""))
def date_and_code_filters(spark, sf):
    rows = cal.between_dates(uni.without_cdr(proxy.panel(spark, sf)), "1997-01-01", "1997-06-01")
    picked = rows.where(F.col("industry_l1").isin("NATION_1", "NATION_2", "NATION_3"))
    return picked.groupBy("code", "date").agg(F.count(F.lit(1)).alias("n"))


@query(with_panel("""
SELECT count(DISTINCT date) AS dates, count(DISTINCT code) AS codes, count(*) AS n, min(date) AS first, max(date) AS last FROM panel"""))
def panel_coverage(spark, sf):
    return proxy.panel(spark, sf).agg(
        F.countDistinct("date").alias("dates"), F.countDistinct("code").alias("codes"),
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"),
    )
