"""Benchmark decontamination: test n-grams in a hash set, training windows looked up in it.

The distinct windows of the benchmark items are broadcast in blocks of a fixed
number of windows; a benchmark of any size takes as many passes over the
documents as it has blocks. A window of document words is a candidate when the
rolling hash of its word numbers is in the set, and a hit only when its words
are a window of the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.text import LOWER_BYTES, others, schema_with
from tidefolio.session import cut_lineage

WINDOW = 10
BLOCK = 200_000  # windows of a block, at most; with their items about 40 MB
#: fixed values: bytes of a word after lower-casing; others end it
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_WORDS = bytes(b if b in _KEPT else 0x20 for b in LOWER_BYTES)
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def split_words(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


def windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """Windows of an item; one of fewer words, but not none, is one window."""
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (item_id, words) of all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                found = sorted(windows(split_words((text.as_py() or "").encode()), size))
                yield pa.record_batch([pa.array([i.as_py()] * len(found), pa.string()), pa.array(found, pa.binary())], ["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "item_id string, words binary").distinct()


@dataclass
class Block:
    """A block of windows as hash set: items by window, word numbers, window hashes by length."""

    items: dict[bytes, tuple[str, ...]]
    number: dict[bytes, int]
    hashes: dict[int, np.ndarray]


def _rolled(numbers: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(numbers) - n + 1), np.uint64)
    for i in range(n if len(h) else 0):
        h = h * _STEP + numbers[i : i + len(h)]
    return h ^ (h >> np.uint64(29))


def make_block(pairs: list[tuple[str, bytes]]) -> Block:
    items: dict[bytes, list[str]] = {}
    for item, words in pairs:
        items.setdefault(words, []).append(item)
    number: dict[bytes, int] = {}
    by_length: dict[int, list[list[int]]] = {}
    for words in items:
        row = [number.setdefault(w, len(number) + 1) for w in words.split(b" ")]
        by_length.setdefault(len(row), []).append(row)
    hashes = {n: np.unique([_rolled(np.array(r, np.uint64), n)[0] for r in rows]) for n, rows in by_length.items()}
    return Block({w: tuple(sorted(i)) for w, i in items.items()}, number, hashes)


def find_hits(words: list[bytes], block: Block) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word spans [start, end) of all windows of the block in the text, and their items."""
    number = block.number.get
    numbers = np.fromiter([number(w, 0) for w in words], np.uint64, len(words))
    known = np.concatenate(([0], np.cumsum(numbers > 0)))
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for n, hashes in block.hashes.items():
        if len(words) < n:
            continue
        at = np.flatnonzero(known[n:] - known[:-n] == n)
        if not len(at):
            continue
        h = _rolled(numbers, n)[at]
        place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        for i in at[hashes[place] == h].tolist():
            found = block.items.get(b" ".join(words[i : i + n]))
            if found:
                spans.append((i, i + n))
                items.update(found)
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between the words of one span."""
    if not spans:
        return text
    out, at, wanted, start = [], 0, iter(spans), 0
    a, b = next(wanted)
    for k, m in enumerate(_WORD.finditer(text)):
        if k == a:
            start = m.start()
        if k == b - 1:
            out.append(text[at:start])
            at = m.end()
            a, b = next(wanted, (-1, -1))
            if a < 0:
                break
    return "".join([*out, text[at:]])


FOUND = ("n_words", "n_hit", "spans", "items")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """All columns of docs and n_words, n_hit, spans (merged word spans) and items (item_ids as strings, sorted).

    Columns of those names are replaced. A null text has no words. Items or
    documents that repeat count as often as they stand there; an empty
    benchmark finds nothing, an empty table gives no row.
    """
    spark = docs.sparkSession
    cuts = cut_lineage(benchmark_windows(benchmark, size))
    blocks = max(1, -(-cuts.count() // block))
    rest = others(docs, FOUND)
    schema = schema_with(docs, rest, "n_words long, n_hit long, spans array<struct<a:int,b:int>>, items array<string>")
    at = docs.select(*rest)
    for k in range(blocks):
        rows = cuts.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k) if blocks > 1 else cuts
        shared = spark.sparkContext.broadcast(make_block([(r[0], bytes(r[1])) for r in rows.collect()]))

        def look(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for row, t in enumerate(batch.column(batch.schema.get_field_index("text"))):
                    words = split_words((t.as_py() or "").encode())
                    spans, items = find_hits(words, shared.value)
                    if not first:  # what earlier blocks found
                        old = batch.column(len(rest) + 2)[row].as_py()
                        spans = merged(spans + [(s["a"], s["b"]) for s in old])
                        items |= set(batch.column(len(rest) + 3)[row].as_py())
                    found.append((len(words), sum(b - a for a, b in spans), [{"a": a, "b": b} for a, b in spans], sorted(items)))
                held = [batch.column(i) for i in range(len(rest))]
                types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string()))
                new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)]
                yield pa.record_batch([*held, *new], [*rest, *FOUND])

        at = at.mapInArrow(look, schema)
        if k < blocks - 1:
            at = cut_lineage(at)
    return at


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Documents without any hit, with their columns but those `scan` replaces."""
    return scan(docs, benchmark, **how).where("n_hit = 0").drop(*FOUND)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """All documents with their columns but those `scan` replaces; hit spans are cut out of `text`."""
    found = scan(docs, benchmark, **how)
    rest = others(docs, FOUND)
    schema, text = schema_with(docs, rest), rest.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(rest))
            texts = [
                t.as_py() if not s else without_spans(t.as_py(), [(x["a"], x["b"]) for x in s])
                for t, s in zip(batch.column(text), spans.to_pylist(), strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if i == text else batch.column(i) for i in range(len(rest))]
            yield pa.record_batch(columns, rest)

    return found.select(*rest, "spans").mapInArrow(cut, schema)
