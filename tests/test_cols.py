"""Rules with a fixed order or tolerance, on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidefolio.functions import cols as c, fixed as K


def test_status_priority(spark):
    rows = [
        # code, ts, close, up, down, list_days, is_st
        ("normal", "交易", 10.0, 11.0, 9.0, 100, 0),
        ("limit_up", "交易", 10.9999, 11.0, 9.0, 100, 0),
        ("limit_down", "交易", 9.0001, 11.0, 9.0, 100, 0),
        ("limit_down", "交易", 10.0, 10.0, 10.0, 100, 0),
        ("suspended", "停牌", 11.0, 11.0, 9.0, 100, 0),
        ("new_listing", "停牌", 11.0, 11.0, 9.0, 59, 0),
        ("normal", "交易", 10.0, 11.0, 9.0, 60, 0),
        ("normal", "交易", 10.0, 11.0, 9.0, None, 0),
        ("new_listing", "停牌", 11.0, 11.0, 9.0, 500, 1),
        ("normal", "XD", 11.0, 11.0, 9.0, 500, 0),
        ("normal", "交易", None, 11.0, 9.0, 500, None),
        ("normal", "交易", 0.0, 0.0, 0.0, 500, 0),
        ("normal", "交易", 10.994, 11.0, 9.0, 500, 0),
    ]
    df = spark.createDataFrame(
        rows, "want string, trade_status string, close double, limit_up double, limit_down double, list_days int, is_st int"
    )
    for r in df.withColumn("got", c.trading_status()).collect():
        assert r.got == r.want, r


def test_order_flags_use_their_own_tolerance(spark):
    df = spark.createDataFrame(
        [("交易", 10.99, 11.0, 9.0), ("交易", 9.008, 11.0, 9.0), ("停牌", None, None, None), ("交易", None, 11.0, 9.0)],
        "trade_status string, close double, limit_up double, limit_down double",
    )
    got = [tuple(r) for r in df.select(c.cannot_buy(), c.cannot_sell()).collect()]
    assert got == [(True, False), (False, True), (True, True), (False, False)]


def test_tiers(spark):
    rows = [(0.5, 10.0, 0.1), (1.0, 10.0, 0.1), (1.01, 10.0, 0.2), (8.0, 10.0, 0.8), (8.1, 10.0, 1.0), (0.0, 10.0, None), (5.0, None, None), (5.0, -1.0, None)]
    df = spark.createDataFrame(rows, "f double, t double, want double")
    for r in df.withColumn("got", c.tier_factor(F.col("f"), F.col("t"))).collect():
        assert r.got == (None if r.want is None else pytest.approx(r.want))


@pytest.mark.parametrize(
    "bound, want",
    [
        (0.3, [0.3, 0.3, 0.3]),
        ({"default": 0.5, "Momentum": 0.2}, [0.5, 0.2, 0.5]),
        ({"Size": 0.3}, [0.3, K.UNBOUNDED, K.UNBOUNDED]),
        ({"default": 1.0, "Beta": 0.1}, [1.0, 1.0, 0.1]),
        ({}, [K.UNBOUNDED] * 3),
    ],
)
def test_style_bounds(spark, bound, want):
    df = spark.createDataFrame([(0, "Size"), (1, "Momentum"), (2, "Beta")], "i int, f string")
    got = df.select("i", c.bound_for(c.bounds_map(bound), F.col("f")).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == want


def test_flexible_dates(spark):
    texts = ["20240102", "2024-01-02", "2024/01/02", "2024-01-02 00:00:00", "20240102.0", " 20240102 "]
    df = spark.createDataFrame([(t,) for t in [*texts, "20241399", "x", "00000000", ""]], "t string")
    got = [r[0] for r in df.select(c.flexible_date(F.col("t"))).collect()]
    assert got == [date(2024, 1, 2)] * len(texts) + [None] * 4
    nums = spark.createDataFrame([(20240102, 20240102.0)], "a long, b double")
    as_text = nums.select(c.flexible_date(F.col("a")), c.flexible_date(F.col("b").cast("long"))).first()
    assert tuple(as_text) == (date(2024, 1, 2), date(2024, 1, 2))


def test_flags_treat_missing_as_false(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "is_zz500 int")
    assert [r[0] for r in df.select(c.is_member("zz500")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(c.is_member("all")).collect()] == [True] * 3
    with pytest.raises(ValueError):
        c.is_member("nothing")


def test_hash_normal_is_standard_and_repeatable(spark):
    df = spark.range(20000).select(c.hash_normal(F.lit(1), F.col("id")).alias("x"))
    mean, std = df.agg(F.avg("x"), F.stddev("x")).first()
    assert abs(mean) < 0.03 and abs(std - 1) < 0.03
    assert df.orderBy("x").first() == df.repartition(7).orderBy("x").first()
