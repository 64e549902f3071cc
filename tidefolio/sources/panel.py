"""The stored daily panel: one Parquet table partitioned by year."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidefolio.functions import fixed as K
from tidefolio.functions.cols import flexible_date, null_if_nan
from tidefolio.operators.timeseries import one_row_per_key

TYPES = {"string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(), "int": T.IntegerType()}
PANEL_TYPE = T.StructType(
    [T.StructField(name, TYPES[kind]) for name, kind in (c.split() for c in K.PANEL_SCHEMA.split(","))]
)


def preset(name: str) -> tuple[str, ...]:
    """Columns of a preset or of a column group."""
    sets = {**K.PRESETS, **K.COLUMN_GROUPS, "default": K.DEFAULT_COLUMNS}
    if name not in sets:
        raise KeyError(f"unknown column set {name!r}; use one of {sorted(sets)}")
    return sets[name]


def derive_panel(raw: DataFrame) -> DataFrame:
    """Warehouse rows to the 40 panel columns, in order and with their types.

    Adds adj_vwap = vwap x adj_factor, free_mv = close x free_shares and
    list_days = date - list_date; columns the source lacks are NULL.
    """
    df = raw.withColumnsRenamed({k: v for k, v in K.WAREHOUSE_NAMES.items() if k in raw.columns})
    df = df.withColumn("date", flexible_date(F.col("date")))
    have = set(df.columns)
    derived = {
        "adj_vwap": (("vwap", "adj_factor"), lambda: F.col("vwap") * F.col("adj_factor")),
        "free_mv": (("close", "free_shares"), lambda: F.col("close") * F.col("free_shares")),
        "list_days": (
            ("list_date",),
            lambda: F.datediff("date", F.try_to_date(F.col("list_date").cast("string"), "yyyyMMdd")),
        ),
    }
    df = df.withColumns({n: make() for n, (needs, make) in derived.items() if have.issuperset(needs)})
    have = set(df.columns)
    out = []
    for field in PANEL_TYPE:
        c = F.col(field.name) if field.name in have else F.lit(None)
        c = c.cast(field.dataType)
        out.append((null_if_nan(c) if field.dataType == T.DoubleType() else c).alias(field.name))
    return df.select(*out)


def write_panel(panel: DataFrame, path: str, files: int | None = None) -> None:
    """Replace the years that ``panel`` holds; other years stay as they are.

    Rows are spread by (date, code) range, so a year is written by many tasks
    and each file covers few dates.
    """
    order = ["date", "code"]
    spread = panel.repartitionByRange(files, *order) if files else panel.repartitionByRange(*order)
    (
        spread.withColumn("year", F.year("date"))
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def missing_years(stored: DataFrame, start: date, end: date) -> DataFrame:
    """(year) of the range that the stored panel has no rows for."""
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    spark = stored.sparkSession
    wanted = spark.range(start.year, end.year + 1).select(F.col("id").cast("int").alias("year"))
    have = stored.where(F.col("year").between(start.year, end.year)).select(F.col("year").cast("int"))
    return wanted.join(have.distinct(), "year", "left_anti")


def year_states(spark: SparkSession, path: str, start: date, end: date) -> DataFrame:
    """(year, files, rows, state) of a stored panel: what each year of the range holds.

    state is ``absent`` without a file, ``empty`` with files but no row, else
    ``present``. Rows stored without a date make one more line, with a NULL
    year and the state ``undated``. Files are listed and rows counted from the
    file footers; no column of the data is read.
    """
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    year = F.col("year").try_cast("int").alias("year")
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        .groupBy(year).agg(F.count(F.lit(1)).alias("files"))
    )
    counted = spark.read.parquet(path).groupBy(year).agg(F.count(F.lit(1)).alias("rows"))
    wanted = spark.range(start.year, end.year + 1).select(F.col("id").cast("int").alias("year"))
    by_year = wanted.join(listed, "year", "left").join(counted, "year", "left").select(
        "year", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("rows", F.lit(0)).alias("rows")
    )
    state = F.when(F.col("files") == 0, "absent").when(F.col("rows") == 0, "empty").otherwise("present")
    undated = listed.join(counted, listed["year"].eqNullSafe(counted["year"])).where(listed["year"].isNull()).select(
        listed["year"], "files", "rows", F.lit("undated").alias("state")
    )
    return by_year.withColumn("state", state).unionByName(undated)


def resolve_columns(columns: Sequence[str] | None, add_adj_vwap: bool = True) -> list[str]:
    """Wanted columns, each once; code and date come first."""
    names = list(K.DEFAULT_COLUMNS) if columns is None else list(dict.fromkeys(["code", "date", *columns]))
    if add_adj_vwap and "adj_vwap" not in names:
        names += [c for c in ("adj_vwap", "vwap", "adj_factor") if c not in names]
    return names


def select_columns(stored: DataFrame, columns: Sequence[str] | None, add_adj_vwap: bool = True) -> DataFrame:
    """Wanted columns under their panel names.

    Older tables hold vwap under another name and may lack adj_vwap, which is
    then computed. Any other absent column is an error.
    """
    have = set(stored.columns)

    def find(name: str):
        if name in have:
            return F.col(name)
        alias = K.COLUMN_ALIASES.get(name)
        if alias in have:
            return F.col(alias)
        return None

    out = []
    for name in resolve_columns(columns, add_adj_vwap):
        c = find(name)
        if c is None and name == "adj_vwap":
            vwap, factor = find("vwap"), find("adj_factor")
            if not add_adj_vwap or vwap is None or factor is None:
                continue
            c = vwap * factor
        if c is None:
            raise KeyError(f"the panel has no column {name!r}; it has {sorted(have)}")
        out.append((c.cast("date") if name == "date" else c).alias(name))
    return stored.select(*out)


def load_panel(
    spark: SparkSession,
    path: str,
    start: date,
    end: date,
    columns: Sequence[str] | str | None = None,
    add_adj_vwap: bool = True,
    check_years: bool = True,
    ordered: bool = False,
) -> DataFrame:
    """Rows of a closed date range.

    ``columns`` is a list, the name of a preset, or None for the default set.
    Years without rows are an error. ``ordered`` sorts by (date, code), which
    only a final result needs.
    """
    stored = spark.read.parquet(path)
    if check_years:
        lost = sorted(r[0] for r in missing_years(stored, start, end).collect())
        if lost:
            raise FileNotFoundError(f"no panel rows for {', '.join(map(str, lost))} in {path}")
    elif start > end:
        raise ValueError(f"start {start} is after end {end}")
    if "year" in stored.columns:
        stored = stored.where(F.col("year").between(start.year, end.year))
    wanted = preset(columns) if isinstance(columns, str) else columns
    rows = select_columns(stored.where(F.col("date").between(F.lit(start), F.lit(end))), wanted, add_adj_vwap)
    return rows.orderBy("date", "code") if ordered else rows


def sync_panel(raw: DataFrame, path: str) -> None:
    """Derive and store the panel of every year in ``raw``; one row per key."""
    write_panel(one_row_per_key(derive_panel(raw)), path)
