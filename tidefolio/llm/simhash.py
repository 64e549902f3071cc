"""SimHash near-duplicates found by fuzzy hashing with the Golay code.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits, each a
word of the perfect (23, 12) Golay code with a few errors. A segment's keys are
the codewords within distance 4, one to six: two segments that differ in two
bits or fewer have a key in common, since the codeword nearest to the point
between them is at most 3 + 1 away from both. Of four differing bits at most
two fall on the two segments that have the fewest, so every linked pair meets
under a key of two segments. Meetings are verified on all 64 bits.

Documents are collapsed to distinct fingerprints first. Within a key,
verified links are followed from member to member and only a spanning forest
is passed on, so a dense group costs its size in rows, not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.components import components
from tidefolio.llm.text import LOWER_BYTES
from tidefolio.session import cut_lineage

SHINGLE = 4
SEED = 42
DISTANCE = 4
Segments = tuple[tuple[int, int], ...]
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit and width
GENERATOR = 0b101011100011  # fixed value: generator polynomial of the Golay code
CHUNK = 1 << 16  # shingles counted at once
SMALL = 16  # keys with up to so many fingerprints are compared all at once
LARGE = 1 << 15  # fingerprints of a key that one task compares at most


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """SimHash of the whole text, unsigned; zero without words."""
    words = data.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, size: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """The key column and the fingerprint as a signed long of each document; null counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint((t.as_py() or "").encode(), size) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return docs.select(key, "text").mapInArrow(work, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


class Golay:
    """Keys of 23-bit words: indices of the codewords within distance 4."""

    def __init__(self) -> None:
        self.check = np.array([self._remainder(i << 11) for i in range(1 << 12)], np.int32)
        near: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                error = sum(1 << b for b in bits)
                near[self.check[error >> 11] ^ error & 0x7FF].append(error)
        most = max(map(len, near))
        self.errors = np.array([e + e[:1] * (most - len(e)) for e in near], np.int32)  # padded by repeats
        self.count = np.array([len(e) for e in near])

    @staticmethod
    def _remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    def keys(self, words: np.ndarray) -> np.ndarray:
        """One row per word; what is past its count repeats the first key."""
        syndrome = self.check[words >> 11] ^ (words & 0x7FF)
        return (words[:, None] ^ self.errors[syndrome]) >> 11

    def counts(self, words: np.ndarray) -> np.ndarray:
        return self.count[self.check[words >> 11] ^ (words & 0x7FF)]


def fuzzy_keys(fps: np.ndarray, golay: Golay, segments: Segments = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) pairs of all fingerprints: a key names two segments and a codeword of each."""
    words = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in segments]
    keys, counts = [golay.keys(w).astype(np.int64) for w in words], [golay.counts(w) for w in words]
    out_keys, out_rows = [], []
    for p, (i, j) in enumerate(combinations(range(len(segments)), 2)):
        both = (p << 24) | (keys[i][:, :, None] << 12) | keys[j][:, None, :]
        real = (np.arange(keys[i].shape[1]) < counts[i][:, None])[:, :, None] & (np.arange(keys[j].shape[1]) < counts[j][:, None])[:, None, :]
        row = np.broadcast_to(np.arange(len(fps))[:, None, None], both.shape)
        out_keys.append(both[real])
        out_rows.append(row[real])
    return np.concatenate(out_keys), np.concatenate(out_rows)


def forest(fps: np.ndarray, most: int = DISTANCE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected among the fingerprints, each found from a member already reached."""
    left, right = [], []
    rest = fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= most
            if near.any():
                met = rest[near]
                left.append(np.full(len(met), x))
                right.append(met)
                queue.extend(met)
                rest = rest[~near]
    return left, right


Connect = Callable[[np.ndarray, int], tuple[list[np.ndarray], list[np.ndarray]]]


def links_in_runs(key: np.ndarray, fps: np.ndarray, most: int = DISTANCE, connect: Connect = forest) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the fingerprints of each key; rows come sorted by key, keys are whole."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    small = np.repeat(size <= SMALL, size)
    left, right = [fps[:0]], [fps[:0]]
    for d in range(1, min(SMALL, size.max(initial=1))):
        a, b = fps[:-d], fps[d:]
        met = (key[:-d] == key[d:]) & small[d:] & (np.bitwise_count(a ^ b) <= most) & (a != b)
        left.append(a[met])
        right.append(b[met])
    for i in np.flatnonzero(size > SMALL):
        a, b = connect(np.unique(fps[first[i] : first[i] + size[i]]), most)
        left += a
        right += b
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(
    fps: DataFrame, most: int = DISTANCE, large: int = LARGE, segments: Segments = SEGMENTS, connect: Connect = forest
) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all within `most` bits.

    A key of more than `large` fingerprints is dealt out in blocks: every two
    blocks meet in a task of their own, so that no task holds the whole key.
    The keys of SEGMENTS are proven for DISTANCE bits; a larger `most` is an
    error with them. Other segments find what shares the codewords of two.
    """
    if segments == SEGMENTS and most > DISTANCE:
        raise ValueError(f"keys meet within {DISTANCE} bits only, not {most}")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fps), 2000):
                part = all_fps[at : at + 2000]
                keys, rows = fuzzy_keys(part.view(np.uint64), golay, segments)
                yield pa.record_batch([pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    keyed = fps.select("fp").mapInArrow(spread, "key long, fp long")
    met = cut_lineage(keyed_links(keyed, most, large, connect))
    links, over = met.where("linked").select("a", "b"), met.where("not linked").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if over.isEmpty():
        return links
    blocks = over.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (large // 2)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = over.join(cut_lineage(blocks), "key").select(
        "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    pairs = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    return links.unionByName(keyed_links(pairs, most, 2**62, connect).select("a", "b"))


def keyed_links(keyed: DataFrame, most: int = DISTANCE, large: int = LARGE, connect: Connect = forest) -> DataFrame:
    """Verified links a, b of the rows (key, fp), and with `linked` false the rows of keys that are too large."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def rows(a, b, linked):
            return pa.record_batch([pa.array(a), pa.array(b.view(np.int64)), pa.array(np.full(len(a), linked))], ["a", "b", "linked"])

        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
                fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(keys):
                continue
            if over is not None:  # the rest of a key that is too large
                n = int(np.searchsorted(keys, over, side="right"))
                yield rows(keys[:n], fps[:n], False)
                keys, fps, over = keys[n:], fps[n:], over if n == len(keys) else None
                if not len(keys):
                    continue
            # the last key may go on in the next batch
            last = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
            if last:
                first = np.flatnonzero(np.concatenate(([True], keys[1:last] != keys[: last - 1])))
                size = np.diff(np.concatenate((first, [last])))
                fit = np.repeat(size <= large, size)
                a, b = links_in_runs(keys[:last][fit], fps[:last][fit], most, connect)
                yield rows(a.view(np.int64), b, True)
                if not fit.all():
                    yield rows(keys[:last][~fit], fps[:last][~fit], False)
                keys, fps = keys[last:], fps[last:]
            if len(keys) > large:
                over = keys[0]
                yield rows(keys, fps, False)
                keys, fps = keys[:0], fps[:0]

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long, linked boolean")


def fingerprint_classes(fps: DataFrame, most: int = DISTANCE) -> DataFrame:
    """The columns of the distinct fingerprints fp, and `component`, the least fingerprint that links reach."""
    classes = components(fingerprint_links(fps, most))
    return cut_lineage(fps.join(classes, fps["fp"] == classes["node"], "left").select(*fps.columns, F.coalesce("component", "fp").alias("component")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, most: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every document.

    Fingerprints link at `most` or fewer differing bits; component_id is the
    least doc_id reachable. A null or empty text has fingerprint zero and is
    linked like any other. A row without doc_id takes the least id of its
    component, null if there is none. Repeated rows agree; an empty table
    gives no row; other columns are ignored.
    """
    rows = cut_lineage(with_fingerprints(docs, size))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    named = fingerprint_classes(fps, most)
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = cut_lineage(named.join(least, "component").select("fp", "component_id"))
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, most: int = DISTANCE) -> DataFrame:
    """One document of each component, with all its columns.

    It is the one with the least doc_id; a row without doc_id stays only if
    its whole component has none, and of rows tied on the id the text with the
    least digest stays. As in exact dedup, rows repeated with the id and text
    of that document are the same document and stay; rows without doc_id are
    not, one of them stays. Rows are told apart by a number written with them;
    columns of docs may have any names.
    """
    docs, names = docs.withColumnsRenamed({c: f"_c{i}" for i, c in enumerate(docs.columns)}), docs.columns
    held = {c: f"_c{i}" for i, c in enumerate(names)}  # so that no column of docs has a name used here
    numbered = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    texts = numbered.select("_row", *[F.col(held[c]).alias(c.lower()) for c in names if c.lower() in ("doc_id", "text")])
    prints = cut_lineage(with_fingerprints(texts, size, "_row"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    rows = cut_lineage(texts.select("_row", "doc_id", digest).join(prints, "_row"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest", "_row")
    fps = cut_lineage(rows.groupBy("fp").agg(F.min(order).alias("first")))
    named = fingerprint_classes(fps, most)
    first = named.groupBy("component").agg(F.min("first").alias("first"))
    known = cut_lineage(named.select("fp", "component").join(first, "component").select("fp", "first"))
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    stays = (F.col("_row") == F.col("first._row")) | F.coalesce(same, F.lit(False))
    lost = cut_lineage(rows.join(known, "fp").where(~stays).select("_row"))
    return numbered.join(lost, "_row", "left_anti").select(*[F.col(held[c]).alias(c) for c in names])
