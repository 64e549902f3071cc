"""Substring deduplication by seeds and their extension.

Seeds: in each window of `length` words the least hash of its k-word grams,
the rightmost of equals, is the window's anchor (winnowing). Equal windows
choose equal anchors at the same place, so any repeat of `length` words shares
a seed. A seed stands for the run of windows that chose it; extended both ways
it covers their words, its context.

Join and extension: documents meet on repeated anchors. Where a seed's whole
context occurs elsewhere, all its windows repeat. Where several contexts share
an anchor, the match ends inside some of them, and their windows are compared
one by one against the windows of all contexts of that anchor. A group is
compared at once by counting digests, never pair by pair, so a passage that
thousands of documents share costs its number of occurrences, not its square.
A word is known by a 128-bit digest; anchors are hashed from one half of it,
contexts and windows from the other, so words that meet in one half part in
the other. What matches is merged to maximal repeats per document. Each row is a document of its own,
known by a number that is written once beside its text, whatever its doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.text import mix64
from tidefolio.llm.words import WordDigests, runs
from tidefolio.session import cut_lineage

LENGTH = 35
GRAM = 8
GRAM_BASE = 0xD6E8FEB86659FD93
CONTEXT_BASE = 0xA0761D6478BD642F
WIDTH = 20  # bits of a place that hold the number of windows


def anchors(words: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the anchor of each window of the text."""
    g, width, base = words, 1, GRAM_BASE
    out, done = None, 0
    while True:  # hashes of `gram` words from those of 1, 2, 4, … words
        if gram & width:
            out = g if out is None else out[: len(g) - done] * np.uint64(base) + g[done:]
            done += width
        if done == gram:
            break
        g = g[: len(g) - width] * np.uint64(base) + g[width:]
        width, base = 2 * width, base * base % 2**64
    value = mix64(out)
    place = np.arange(len(value))
    n, span = length - gram + 1, 1
    while span < n:  # least of 1, 2, 4, … grams; the right one wins a tie
        step = min(span, n - span)
        a, b = value[:-step], value[step:]
        right = b <= a
        value, place = np.where(right, b, a), np.where(right, place[step:], place[:-step])
        span += step
    return value, place


def seeds_of(words: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor, context hash, first window and number of windows of each seed of a text, from the digests of its words."""
    if len(words) < length:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    value, place = anchors(words[:, 0], length, gram)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    n = np.diff(np.concatenate((first, [len(place)])))
    return value[first], mix64(runs(words[:, 1], first, first + n - 1 + length, CONTEXT_BASE) + n.astype(np.uint64)), first, n


def packed(docs: DataFrame) -> DataFrame:
    """row, doc_id and the text compressed; row is a number of its own for each row, written with it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            blobs = [None if not t.is_valid else z.compress(t.as_py().encode()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["row", "doc_id", "blob"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(texts.mapInArrow(pack, "row long, doc_id long, blob binary"))


def _unpack(blob: pa.Scalar) -> bytes:
    return zstandard.decompress(blob.as_py()) if blob.is_valid else b""


def find_seeds(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """anchor, context, row, place of every seed of the packed texts; place holds first window and number of windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for batch in batches:
            start, held, total = 0, [], 0
            for row, blob in enumerate(batch.column(1)):
                a, c, first, n = seeds_of(digests.of_text(_unpack(blob)), length, gram)
                held.append((a, c, (first << WIDTH) | n))
                total += len(a)
                if total >= 200_000 or row == batch.num_rows - 1:
                    ids = batch.column(0).slice(start, len(held)).take(pa.array(np.repeat(np.arange(len(held)), [len(h[0]) for h in held])))
                    joined = [np.concatenate([h[i] for h in held]).view(np.int64) for i in range(3)]
                    yield pa.record_batch([pa.array(joined[0]), pa.array(joined[1]), ids, pa.array(joined[2])], ["anchor", "context", "row", "place"])
                    start, held, total = row + 1, [], 0

    return texts.select("row", "blob").mapInArrow(work, "anchor long, context long, row long, place long")


def find_windows(texts: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """anchor, window hash, row, place and `open` of each window of the wanted seeds.

    wanted: row, place, anchor, open.
    """
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "place", "open")).alias("seeds"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for batch in batches:
            for row in range(batch.num_rows):
                words = digests.of_text(_unpack(batch.column(1)[row]))[:, 1]
                seeds = batch.column(2)[row].values
                anchor, place, opened = (f.to_numpy(zero_copy_only=False) for f in seeds.flatten())
                first, n = place >> WIDTH, place & (1 << WIDTH) - 1
                at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                hashes = mix64(runs(words, at, at + length, CONTEXT_BASE))
                places = (at << WIDTH) | 1
                ids = pa.repeat(batch.column(0)[row], len(at))
                yield pa.record_batch(
                    [pa.array(np.repeat(anchor, n)), pa.array(hashes.view(np.int64)), ids, pa.array(places), pa.array(np.repeat(opened, n).astype(bool))],
                    ["anchor", "window", "row", "place", "open"],
                )

    return texts.join(lists, "row").select("row", "blob", "seeds").mapInArrow(
        work, "anchor long, window long, row long, place long, open boolean"
    )


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row, place of all runs of windows of the packed texts whose words start elsewhere too."""
    seeds = cut_lineage(find_seeds(texts, length, gram))
    twice = cut_lineage(seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    met = cut_lineage(seeds.join(twice, "anchor"))
    contexts = cut_lineage(
        met.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"), F.first("place").alias("place"))
    )
    whole = met.join(contexts.where("n > 1").select("anchor", "context"), ["anchor", "context"]).select("row", "place")
    several = cut_lineage(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"))
    wanted = contexts.join(several, "anchor").select("row", "place", "anchor", (F.col("n") == 1).alias("open"))
    windows = cut_lineage(find_windows(texts, wanted, length))
    same = cut_lineage(windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "window"))
    part = windows.where("open").join(same, ["anchor", "window"]).select("row", "place")
    return whole.unionByName(part)


def covered(n_words: int, places: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which words of a text stand in a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    first, n = places >> WIDTH, places & (1 << WIDTH) - 1
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, spans and kept of every document.

    spans are the maximal repeats as word ranges [a, b), kept the other words
    joined by a space.

    A word goes when a window of `length` words around it also starts anywhere
    else, in the same document or another, a repeated row included; the first
    occurrence goes too. Words are what stands between space and 0x09-0x0D.
    A null text has no words; texts of fewer than `length` words stay whole;
    rows without doc_id are judged alike. Other columns are ignored; an empty
    table gives no row. Texts of any length are read whole.
    """
    if not 0 < gram <= length or length - gram + 1 >= 1 << WIDTH:
        raise ValueError(f"windows of {length} words need grams of 1 to {length} words and fewer than {1 << WIDTH} of them")
    texts = packed(docs)
    lists = repeats(texts, length, gram).groupBy("row").agg(F.collect_list("place").alias("places"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob, places in zip(batch.column(1), batch.column(2), strict=True):
                words, gone, spans = _unpack(blob).split(), 0, []
                n = len(words)
                if places.is_valid and len(places):
                    away = covered(n, places.values.to_numpy(zero_copy_only=False), length)
                    gone = int(away.sum())
                    edges = np.flatnonzero(np.diff(away.view(np.int8), prepend=0, append=0)).tolist()
                    spans = [{"a": a, "b": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    words = [words[i] for i in np.flatnonzero(~away).tolist()]
                out.append((n, gone, spans, b" ".join(words)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.binary())
            yield pa.record_batch(
                [batch.column(0), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))],
                ["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    joined = texts.join(lists, "row", "left").select("doc_id", "blob", "places")
    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, spans array<struct<a:int,b:int>>, kept binary").withColumn(
        "kept", F.col("kept").cast("string")
    )
