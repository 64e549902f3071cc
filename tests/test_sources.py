"""Stored panels, index files, alpha layouts, risk tables."""

from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidefolio.session import new_table_path
from tidefolio.sources import alpha, index_close as ic, panel as store, risk as risk_source

# Index file and expected results.
INDEX = """date,沪深300,中证500,中证1000,中证红利,万得全A
20200102,4000.0,5000.0,6000.0,,5500.0
20200103,4040.0,5050.0,6060.0,,5555.0
20200106,4000.0,5100.0,6000.0,,5600.0
"""


@pytest.fixture
def index_csv(tmp_path):
    path = tmp_path / "index.csv"
    path.write_text(INDEX, encoding="utf-8")
    return str(path)


def test_index_by_key_and_name(spark, index_csv):
    rows = ic.load_index_close(spark, "hs300", index_csv, "2020-01-03", "2020-01-03").collect()
    assert [(r.date, r.close) for r in rows] == [(date(2020, 1, 3), 4040.0)]
    assert ic.load_index_close(spark, "中证500", index_csv, "2020-01-03", "2020-01-06").count() == 2
    assert ic.load_index_close(spark, "winda", index_csv).count() == 3


def test_index_first_day_return(spark, index_csv):
    rows = ic.load_index_returns(spark, "hs300", index_csv, "2020-01-03", "2020-01-03").collect()
    assert [r.date for r in rows] == [date(2020, 1, 3)]
    assert rows[0].ret == pytest.approx(0.01)


def test_index_availability_and_errors(spark, index_csv):
    names = {r.index_key for r in ic.available_indices(spark, index_csv).collect()}
    assert names == {"沪深300", "中证500", "中证1000", "万得全A"}
    with pytest.raises(KeyError):
        ic.load_index_close(spark, "zz800", index_csv)
    with pytest.raises(ValueError):
        ic.load_index_close(spark, "hs300", index_csv, "2021-01-01")
    with pytest.raises(ValueError):
        ic.load_index_close(spark, "dividend", index_csv)


def _raw(spark, years=(2023, 2024)):
    rows = [
        (f"00000{i}.SZ", f"{y}-01-0{d}", 10.0 + i, 9.0, 2.0, 100.0, "20230101", float("nan"))
        for y in years for d in (2, 3) for i in (1, 2)
    ]
    return spark.createDataFrame(
        rows, "code string, trade_dt string, close double, avg_price double, adj_factor double, free_shares double, list_date string, turn double"
    )


def test_panel_round_trip(spark):
    path = new_table_path(spark, "t")
    store.sync_panel(_raw(spark), path)
    got = store.load_panel(spark, path, date(2023, 1, 3), date(2024, 1, 2), ["adj_vwap", "free_mv", "list_days", "turnover"], ordered=True)
    assert got.columns == ["code", "date", "adj_vwap", "free_mv", "list_days", "turnover"]
    rows = [tuple(r) for r in got.collect()]
    assert rows[0] == ("000001.SZ", date(2023, 1, 3), 18.0, 1100.0, 2, None)
    assert [r[1] for r in rows] == [date(2023, 1, 3)] * 2 + [date(2024, 1, 2)] * 2
    stored = spark.read.parquet(path)
    assert [c for c in stored.columns if c != "year"] == store.PANEL_TYPE.names and len(store.PANEL_TYPE) == 40


def test_panel_year_is_replaced_alone(spark):
    path = new_table_path(spark, "t")
    store.sync_panel(_raw(spark), path)
    store.sync_panel(_raw(spark, (2024,)).withColumn("close", F.lit(99.0)), path)
    got = spark.read.parquet(path).groupBy("year").agg(F.max("close"), F.count(F.lit(1))).orderBy("year").collect()
    assert [tuple(r) for r in got] == [(2023, 12.0, 4), (2024, 99.0, 4)]


def test_panel_errors(spark):
    path = new_table_path(spark, "t")
    store.sync_panel(_raw(spark), path)
    with pytest.raises(FileNotFoundError, match="2022, 2025"):
        store.load_panel(spark, path, date(2022, 1, 1), date(2025, 1, 1))
    with pytest.raises(ValueError):
        store.load_panel(spark, path, date(2024, 1, 2), date(2023, 1, 1))
    with pytest.raises(KeyError):
        store.load_panel(spark, path, date(2023, 1, 1), date(2023, 12, 31), ["nothing"])
    with pytest.raises(KeyError):
        store.preset("nothing")


def test_old_column_name_and_missing_adj_vwap(spark):
    old = spark.createDataFrame([("1.SZ", date(2024, 1, 2), 5.0, 3.0)], "code string, date date, avg_price double, adj_factor double")
    assert tuple(store.select_columns(old, ["vwap"]).first()) == ("1.SZ", date(2024, 1, 2), 5.0, 15.0, 3.0)
    assert store.select_columns(old, ["vwap", "adj_vwap"], add_adj_vwap=False).columns == ["code", "date", "vwap"]


def test_date_range_prunes_partitions(spark):
    path = new_table_path(spark, "t")
    store.sync_panel(_raw(spark), path)
    plan = store.load_panel(spark, path, date(2024, 1, 1), date(2024, 12, 31), "signal_only")._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line][-1]
    assert "PartitionFilters: [isnotnull(year" in scan and "limit_up" not in scan.split("ReadSchema")[1]


def test_alpha_layouts(spark, tmp_path):
    wide = pd.DataFrame({"1.SZ": [1.0, None], "2.SZ": [3.0, 4.0]}, index=pd.Index([20240102, 20240103], name="date"))
    long = wide.reset_index().melt("date", var_name="code", value_name="alpha")
    for name, pdf in (("w1", wide), ("w2", wide.rename_axis(None)), ("l", long)):
        path = str(tmp_path / f"{name}.parquet")
        pdf.to_parquet(path)
        rows = {tuple(r) for r in alpha.load_alpha(spark, path).collect()}
        assert rows == {
            (date(2024, 1, 2), "1.SZ", 1.0), (date(2024, 1, 2), "2.SZ", 3.0), (date(2024, 1, 3), "2.SZ", 4.0)
        }


def test_alpha_asof_takes_the_date_row(spark):
    uni = spark.createDataFrame([(date(2024, 1, 5), "a"), (date(2024, 1, 5), "b"), (date(2024, 1, 1), "a")], "date date, code string")
    scores = spark.createDataFrame(
        [(date(2024, 1, 2), "a", 1.0), (date(2024, 1, 2), "b", 2.0), (date(2024, 1, 4), "a", 3.0), (date(2024, 1, 6), "b", 9.0)],
        "date date, code string, alpha double",
    )
    got = {(r.date, r.code): r.alpha for r in alpha.alpha_asof(uni, uni.select("date").distinct(), scores).collect()}
    # b has no row on the 4th, so it is 0 although it had one on the 2nd
    assert got == {(date(2024, 1, 5), "a"): 3.0, (date(2024, 1, 5), "b"): 0.0, (date(2024, 1, 1), "a"): 0.0}


def test_wide_risk_tables(spark):
    d = date(2024, 1, 2)
    expo = spark.createDataFrame([(d, "a", 1.5, 0.0, 0.2), (d, "b", float("nan"), 1.0, None)], "rebal_date date, code string, Size double, Bank double, spec_var double")
    long, spec = risk_source.long_exposures(expo)
    assert {tuple(r) for r in long.collect()} == {(d, "a", "Size", 1.5), (d, "b", "Bank", 1.0)}
    assert {(r.code, r.spec_var) for r in spec.collect()} == {("a", 0.2), ("b", None)}
    cov = spark.createDataFrame([(d, "Size", 1.0, 0.2), (d, "Bank", 0.4, 2.0)], "rebal_date date, factor string, Size double, Bank double")
    got = {(r.factor_i, r.factor_j): r.cov for r in risk_source.long_covariance(cov).collect()}
    assert got == pytest.approx({("Size", "Size"): 1.0, ("Size", "Bank"): 0.3, ("Bank", "Size"): 0.3, ("Bank", "Bank"): 2.0})


def test_summary_is_one_csv(spark, tmp_path):
    from tidefolio.sources.sinks import write_summary

    path = str(tmp_path / "summary")
    df = spark.createDataFrame([(0.05, 0.1), (0.08, 0.2)], "in_ic double, ic double").repartition(3)
    write_summary(df, path)
    assert len(list((tmp_path / "summary").glob("*.csv"))) == 1
    assert spark.read.csv(path, header=True).columns == ["in_ic", "ic"]


def test_fills(spark):
    from tidefolio.operators.universe import fill_missing

    df = spark.createDataFrame([(None, None, None, 2.0)], "adv double, industry string, bm_weight double, alpha double")
    assert tuple(fill_missing(df).first()) == (1e5, "未知", 0.0, 2.0)


def test_warehouse_reads_only_selects(spark):
    from tidefolio.sources.warehouse import read_query

    with pytest.raises(ValueError):
        read_query(spark, "DROP TABLE x")


def test_year_states_tell_absent_empty_and_undated(spark):
    path = new_table_path(spark, "panel")
    rows = spark.createDataFrame([("a", date(2001, 5, 1)), ("b", date(2001, 5, 2)), ("a", date(2004, 1, 1)), ("c", None)], "code string, date date")
    store.write_panel(rows, path)
    rows.where("code = 'none'").coalesce(1).write.parquet(f"{path}/year=2002")
    got = {r.year: (r.rows, r.state) for r in store.year_states(spark, path, date(2001, 1, 1), date(2003, 12, 31)).collect()}
    assert got == {2001: (2, "present"), 2002: (0, "empty"), 2003: (0, "absent"), None: (1, "undated")}
    assert {r.year for r in store.missing_years(spark.read.parquet(path), date(2001, 1, 1), date(2003, 12, 31)).collect()} == {2002, 2003}
    with pytest.raises(ValueError):
        store.year_states(spark, path, date(2003, 1, 1), date(2001, 1, 1))
