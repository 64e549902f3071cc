"""As-of index weights on the asked dates alone."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidefolio.operators import benchmark as bm

COLUMNS = "date date, code string, total_mv double, free_mv double, is_hs300 int"


@pytest.fixture
def panel(spark):
    """Codes join, leave, miss values; every fifth day has no member."""
    first, rows = date(2020, 1, 1), []
    for i in range(40):
        for k in range(12):
            member = i % 5 != 4 and (i * 7 + k * 5) % 11 != 0 and not (k == 3 and i > 20) and not (k == 4 and i < 25)
            value = None if (i + k) % 6 == 0 else 100.0 + i * (k + 1)
            rows.append((first + timedelta(days=i), f"c{k:02d}", value, 60.0, int(member)))
    return spark.createDataFrame(rows, COLUMNS)


def _rows(df):
    return sorted((r.date, r.code, round(r.bm_weight, 12)) for r in df.collect())


@pytest.mark.parametrize("max_rows", [None, 100])
def test_asked_dates_hold_the_weights_of_all_days(spark, panel, max_rows):
    first = date(2020, 1, 1)
    everything = bm.benchmark_weights(panel, "hs300")
    days = sorted({r[0] for r in everything.select("date").distinct().collect()})
    for offsets in ([0], [4, 9, 9, 14], [-3, 7, 39, 400], range(40), []):
        targets = [first + timedelta(days=i) for i in offsets]
        asked = {max(d for d in days if d <= t) for t in targets if t >= days[0]}
        got = bm.benchmark_weights_at(panel, "hs300", spark.createDataFrame([(t,) for t in targets], "date date"), max_rows=max_rows)
        assert _rows(got) == _rows(everything.where(F.col("date").isin(*asked) if asked else F.lit(False)))


def test_no_members_no_rows(spark, panel):
    targets = panel.select("date").distinct()
    assert bm.benchmark_weights_at(panel.withColumn("is_hs300", F.lit(0)), "hs300", targets).isEmpty()
