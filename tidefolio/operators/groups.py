"""Per-group work that does not depend on how large one group is.

A cross-section (one date, or one scenario and date) is usually a few thousand
names, and a plain window over it is the best plan: one shuffle, nothing read
twice. It may also be the hot key that holds a third of the table. Each
function here therefore takes ``max_rows``, an upper bound of the rows in one
group. Up to the limit of ``spark.tidefolio.maxRowsPerTask`` the window plan is
used. Beyond it, or without a bound, the group is split: aggregates are
partially aggregated before the shuffle and joined back, and anything that
needs an order is sorted by range over all tasks, numbered within each range
and shifted by the totals of the ranges before it.

Both plans give the same rows: rows whose group key is NULL are one group, a
NULL value has no rank and counts in no other's, and a running sum is NULL
until the first known value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidefolio.session import cut_lineage

LIMIT_KEY = "spark.tidefolio.maxRowsPerTask"
DEFAULT_LIMIT = 4_000_000
TOP_SALTS = 64


def row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_KEY, str(DEFAULT_LIMIT)))


def fits_one_task(df: DataFrame, max_rows: int | None) -> bool:
    """Whether the caller's bound of a group's rows allows the window plan; nothing is counted."""
    return max_rows is not None and max_rows <= row_limit(df)


def join_groups(df: DataFrame, found: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on the keys, NULL keys meeting each other; the keys stay those of df."""
    right = found.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(right, same, how).drop(*[f"_k_{k}" for k in keys])


def repeat_for(df: DataFrame, parameters: DataFrame, most: int = 100_000) -> DataFrame:
    """Each row once per row of a parameter table, with its columns.

    The table is read once, as a scalar subquery, so the plan does not grow
    with it. It reaches every task whole and may have ``most`` rows.
    """
    if parameters.limit(most + 1).count() > most:
        raise ValueError(f"a parameter table of over {most} rows; run it in parts")
    rows = parameters.agg(F.collect_list(F.struct(*parameters.columns)))
    return df.withColumn("_all", rows.scalar()).withColumn("_p", F.explode("_all")).select("_p.*", *df.columns)


def with_aggregates(
    df: DataFrame, group: Sequence[str], aggs: Mapping[str, Column], max_rows: int | None = None
) -> DataFrame:
    """Add aggregates of the row's group as columns."""
    if fits_one_task(df, max_rows):
        w = Window.partitionBy(*group)
        return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    df = cut_lineage(df)
    totals = df.groupBy(*group).agg(*[agg.alias(name) for name, agg in aggs.items()])
    return join_groups(df, totals, group)


def _by_range(df: DataFrame, group: Sequence[str], order: Sequence[Column], max_rows: int | None) -> DataFrame:
    """Rows sorted by range over all tasks, with the number of their range.

    The range borders come from a sample, so they differ from run to run; the
    rows are written once and both uses below read the same numbers.
    """
    spark = df.sparkSession
    n = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-(max_rows or 0) // row_limit(df)),
    )
    ranged = df.repartitionByRange(min(n, 100_000), *[F.col(g) for g in group], *order)
    return cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    max_rows: int | None = None,
) -> DataFrame:
    """Add running totals (this row included); ``order`` must have no ties."""
    full = (Window.unboundedPreceding, Window.currentRow)
    if fits_one_task(df, max_rows):
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(*full)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})

    ranged = _by_range(df, group, order, max_rows)
    keys = [*group, "_range"]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*keys)
        .agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
        .select(*keys, *[F.sum(f"_t_{n}").over(before).alias(f"_s_{n}") for n in sums])
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*full)
    own = ranged.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
    return (
        join_groups(own, shifts, keys)
        .withColumns({n: F.coalesce(F.col(n) + F.col(f"_s_{n}"), F.col(n), F.col(f"_s_{n}")) for n in sums})
        .drop("_range", *[f"_s_{n}" for n in sums])
    )


def row_numbers(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, max_rows: int | None = None
) -> DataFrame:
    """Add the position within the group, from 1; ``order`` must have no ties."""
    if fits_one_task(df, max_rows):
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    return running_sums(df, group, order, {name: F.lit(1).cast("long")}, max_rows)


def average_ranks(
    df: DataFrame, group: Sequence[str], values: Mapping[str, str], max_rows: int | None = None
) -> DataFrame:
    """Add ranks from 1 with ties at their mean, NULL for NULL; ``values``: rank name -> column."""
    if fits_one_task(df, max_rows):
        # a date's rows are already together, so the tie count costs no shuffle
        for name, value in values.items():
            lower = F.rank().over(Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last()))
            ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
            df = df.withColumn(name, F.when(F.col(value).isNotNull(), lower + (ties - 1) / F.lit(2.0)))
        return df
    df = cut_lineage(df)
    for name, value in values.items():
        known = df.where(F.col(value).isNotNull())
        distinct = known.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
        upto = running_sums(distinct, group, [F.col(value)], {"_upto": F.col("_n")}, max_rows)
        ranks = upto.select(
            *group, value, (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(name)
        )
        df = join_groups(df, ranks, [*group, value])
    return df


def quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    max_rows: int | None = None,
) -> DataFrame:
    """Exact quantiles per group, linear between neighbours, one row per group."""
    rows = df.where(F.col(value).isNotNull())
    if fits_one_task(rows, max_rows):
        found = rows.groupBy(*group).agg(
            F.percentile(value, F.array(*[F.lit(p) for p in probs.values()])).alias("_q")
        )
        return found.select(*group, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])

    distinct = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = cut_lineage(running_sums(distinct, group, [F.col(value)], {"_upto": F.col("_n")}, max_rows))
    sized = join_groups(upto, upto.groupBy(*group).agg(F.max("_upto").alias("_size")), group)
    picks, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        place = (F.col("_size") - 1) * F.lit(float(p))
        # the value at a 0-based place is the first one whose running count exceeds it
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.min(F.when(F.col("_upto") > at, F.col(value))).alias(f"_{end}{i}"))
        part = (F.col("_rows") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * (part - F.floor(part))).alias(name))
    return sized.groupBy(*group).agg(F.max("_size").alias("_rows"), *picks).select(*group, *out)


def with_median(
    df: DataFrame, group: Sequence[str], value: str, name: str, max_rows: int | None = None
) -> DataFrame:
    """Add the median of the group's known values."""
    if fits_one_task(df, max_rows):
        return df.withColumn(name, F.median(value).over(Window.partitionBy(*group)))
    df = cut_lineage(df)
    return join_groups(df, quantiles(df, group, value, {name: 0.5}, max_rows), group)


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, salt: str = "code") -> DataFrame:
    """The first ``k`` rows of each group.

    Each of 64 shares of a group keeps its own first k, then the survivors
    (at most 64 k per group) are ranked; no task sees a whole hot group.
    """
    share = df.withColumn("_share", F.pmod(F.xxhash64(salt), F.lit(TOP_SALTS)))
    first = Window.partitionBy(*group, "_share").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    return (
        share.withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= k)
        .withColumn("_rn", F.row_number().over(last))
        .where(F.col("_rn") <= k)
        .drop("_share", "_rn")
    )
