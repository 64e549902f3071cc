"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and numbered; row r of a
source of n rows stands at (r + u) / n, where u is a seeded phase of the
source, so that sources of a row or two spread over all shards instead of
meeting in the middle. Sorted by that fraction, every stretch of rows holds the
sources in the proportions of the whole, and equal cuts give shards that match
the mixture with row counts at most one apart.

Only slim rows are sorted, never texts. Both numberings sort by range over all
tasks, so a source that holds most rows is no hot group. Copies are rows like
others: the method knows no groups of texts. Only built-in functions; no Python
runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.text import others
from tidefolio.operators.groups import join_groups, row_numbers
from tidefolio.session import cut_lineage, new_table_path

SHARDS = 24
SEED = "shards-1"
DIGITS = 15  # hex digits of a hash that are used, so that it is a positive long


def seeded(seed: str, *parts: Column) -> Column:
    """Hash of the parts that are not null, from 0 to 2**60 - 1."""
    text = F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows written once with a number each, and the number's column, which no column of docs has."""
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id())), name


def _placed(rows: DataFrame, shards: int, seed: str) -> DataFrame:
    """Shard and slot of written rows (row, doc_id, source, size, text_crc32)."""
    total = rows.count()
    rows = cut_lineage(rows.withColumn("_h", seeded(seed, F.col("doc_id"), F.col("text_crc32"))))
    ranked = row_numbers(rows, ["source"], [F.col("_h"), F.col("row")], "_rank")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    phase = seeded(seed, F.col("source")) / F.lit(float(16**DIGITS))
    spread = join_groups(ranked, sizes, ["source"]).withColumn("_at", (F.col("_rank") - 1 + phase) / F.col("_n"))
    order = [F.col("_at"), F.col("source").asc_nulls_first(), F.col("_rank")]
    placed = row_numbers(spread, [], order, "_place").withColumn("_place", F.col("_place") - 1)
    shard = F.expr(f"_place * {shards} div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("_place") - start)
        .select("row", "doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
    )


def _slim(docs: DataFrame, row: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        row.alias("row"),
        "doc_id",
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def placements(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per document: row, doc_id, source, size, text_crc32, shard (from 0), slot (from 0 in its shard).

    size is the text's UTF-8 bytes plus 8, text_crc32 its unsigned CRC-32; a
    null text counts as empty. Rows without a source are a source of their
    own. Where a row comes depends on its doc_id, text and source, the other
    rows and the seed alone; rows equal in all three are dealt alike in any
    order. Shards differ by one row at most; with fewer rows than shards some
    have none. Texts of any length are read once; other columns are ignored;
    an empty table gives no row.
    """
    return _placed(cut_lineage(_slim(docs, F.monotonically_increasing_id())), shards, seed)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """All columns of docs with shard and slot, as `placements` gives them; columns of these names are replaced."""
    rest = others(docs, ("shard", "slot"))
    rows, number = numbered(docs.select(*rest))
    placed = _placed(cut_lineage(_slim(rows, F.col(number))), shards, seed)
    found = placed.select(F.col("row").alias(number), "shard", "slot")
    return rows.join(found, number).drop(number)


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS, seed: str = SEED, files: int | None = None) -> str:
    """Write the shards as Parquet folders shard=0, shard=1, …; returns the path.

    Rows are dealt by ranges of (shard, slot), so a shard of any size is
    written by many tasks; its files in order of name hold its slots in order.
    """
    spark = docs.sparkSession
    path = path or new_table_path(spark, "shards")
    placed = shard_documents(docs, shards, seed)
    n = files or max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
