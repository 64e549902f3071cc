"""Files that arrive in two goes end as one panel."""

from datetime import date

from pyspark.sql import functions as F

from tidefolio.session import new_table_path
from tidefolio.streaming.panel_feed import merge_panel, start_feed

SCHEMA = "code string, trade_dt string, close double, free_shares double"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_feed_merges_new_and_corrected_rows(spark):
    source, path, state = (new_table_path(spark, n) for n in ("source", "panel", "state"))
    first = _rows(spark, [("a", "20231229", 1.0, 2.0), ("a", "20240102", 2.0, 2.0), ("b", "20240102", 3.0, 2.0)])
    first.write.parquet(source)
    start_feed(spark, source, first.schema, path, state).awaitTermination()
    second = _rows(spark, [("b", "20240102", 30.0, 2.0), ("a", "20240103", 4.0, 2.0)])
    second.write.mode("append").parquet(source)
    start_feed(spark, source, first.schema, path, state).awaitTermination()
    got = {(r.date, r.code): (r.close, r.free_mv) for r in spark.read.parquet(path).collect()}
    assert got == {
        (date(2023, 12, 29), "a"): (1.0, 2.0),
        (date(2024, 1, 2), "a"): (2.0, 4.0),
        (date(2024, 1, 2), "b"): (30.0, 60.0),
        (date(2024, 1, 3), "a"): (4.0, 8.0),
    }


def test_merging_twice_changes_nothing(spark):
    path = new_table_path(spark, "panel")
    batch = _rows(spark, [("a", "20240102", 2.0, 2.0), ("a", "bad", 2.0, 2.0)])
    merge_panel(batch, path)
    merge_panel(batch, path)
    assert spark.read.parquet(path).agg(F.count(F.lit(1))).first()[0] == 1
