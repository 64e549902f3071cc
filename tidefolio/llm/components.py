"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node's larger (or smaller) neighbours are tied to the least node next to it.

    The least neighbours are written first, so the join with a node of very
    many edges is dealt from plain exchanges, which the engine can split.
    """
    ends = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a > b in every edge; large: all neighbours, small: only the smaller ones
    least = cut_lineage(ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    met = ends.join(least, "a")
    tied = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else (
        met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    )
    return cut_lineage(tied.where(F.col("a") > F.col("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of an edge: the component is its least node.

    edges: a, b of one ordered type; direction, loops and repeats do not
    matter. The driver sees one count and one checksum per round.
    """
    at = cut_lineage(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    last = None
    while True:
        at = _stars(_stars(at, True), False)
        now = at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == last:
            break
        last = now
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
