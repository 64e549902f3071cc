"""Exact deduplication by skew-safe combining.

Rows are first combined inside their own partition, then per salted digest
group, then the winners of all salts are combined. Every stage groups by the
whole content beside its digest, so two contents never meet in one group. A
content held by a third of all rows sends one row per input partition to each
later stage. Only built-in functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.text import ascii_lower
from tidefolio.session import cut_lineage

SALTS = 16


def normalised(text: Column) -> Column:
    """Content that is compared: A-Z lower-cased, null as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content, as bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def content_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct content: digest, keep_id, group_size.

    keep_id is the largest doc_id, null if the group has none. Two contents
    with one SHA-256 end the job: the digest then names no single group.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("content")).select(
        "doc_id",
        "content",
        F.unhex(F.sha2("content", 256)).alias("digest"),
        (F.spark_partition_id() % salts).alias("salt"),
    )
    salted = rows.groupBy("digest", "content", "salt").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    whole = salted.groupBy("digest", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    named = whole.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("contents"),
    )
    shared = F.raise_error(F.lit("two contents have one SHA-256")).cast("long")
    return named.select(
        "digest", "keep_id", F.when(F.col("contents") > 1, shared).otherwise(F.col("group_size")).alias("group_size")
    )


def exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Verdict per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. The row with the largest doc_id of a group stays; rows repeated
    with that id and text are the same document and all marked kept. A row
    without doc_id stays only if its whole group has none. Other columns are
    ignored; an empty table gives no row.
    """
    groups = cut_lineage(content_groups(docs, salts))
    rows = docs.select("doc_id", content_digest(F.col("text")).alias("digest"))
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns.

    Only ids and digests of rows to drop are joined; a row is known by its id
    and content, so an id used for several texts loses none of the others.
    """
    digest = content_digest(F.col("text"))
    lost = exact_duplicates(docs, salts).where(~F.col("kept"))
    lost = lost.select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest")).distinct()
    return docs.join(lost, docs["doc_id"].eqNullSafe(lost["_id"]) & (digest == lost["_digest"]), "left_anti")
