"""Panel files that arrive over time, merged into the stored panel.

Re-pulling a whole year becomes a file stream: each micro-batch of raw rows is
derived like a full load and merged by (date, code) into the years it touches.
Merging the same batch again changes nothing, so a restart after a lost driver
or executor is safe.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidefolio.operators.timeseries import one_row_per_key
from tidefolio.session import cut_lineage
from tidefolio.sources.panel import PANEL_TYPE, derive_panel, write_panel


def _stored_rows(spark: SparkSession, path: str, years: list[int]) -> DataFrame | None:
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return stored.where(F.col("year").isin(years)).select(*PANEL_TYPE.names)


def merge_panel(raw: DataFrame, path: str) -> None:
    """Put raw rows into the stored panel; they replace stored rows of the same key."""
    fresh = cut_lineage(one_row_per_key(derive_panel(raw)).where(F.col("date").isNotNull()))
    years = [r[0] for r in fresh.select(F.year("date")).distinct().collect()]
    if not years:
        return
    old = _stored_rows(raw.sparkSession, path, years)
    if old is not None:
        kept = old.join(fresh.select("date", "code"), ["date", "code"], "left_anti")
        # the rows come from the years about to be replaced, so they are written aside first
        fresh = cut_lineage(kept.unionByName(fresh))
    write_panel(fresh, path)


def start_feed(
    spark: SparkSession, source: str, schema: StructType, path: str, state: str, files_per_batch: int = 100
) -> StreamingQuery:
    """Merge every file not seen yet under ``source``, then stop.

    ``state`` keeps which files are done; use the same folder at each start.
    """
    rows = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", str(files_per_batch))
        .parquet(source)
    )
    return (
        rows.writeStream.foreachBatch(lambda batch, _: merge_panel(batch, path))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
