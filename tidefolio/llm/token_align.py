"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes.

Each side's cumulative byte ends rise, so the ends of one side are looked up
among the other's. Those that both hold slice both id lists into groups, and every
slice is expanded to the links of tokens that end together. Texts are encoded
once; their links are written as packed numbers, counted over the corpus, and
scored against a table of counts in broadcast blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.text import others, schema_with
from tidefolio.session import cut_lineage

BLOCK = 2_000_000  # pairs of a broadcast block at most, 17 bytes each
OUT = 1 << 22  # packed bytes per result batch
FOUND = ("a_ids", "b_ids", "a_cuts", "b_cuts")
#: fixed values: the character of a space in a piece, and of a byte without a letter of its own
SPACE = "▁"
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


@dataclass
class Files:
    """What the driver read of both tokenizers; of fixed size, broadcast to the workers."""

    a: bytes  # JSON of a byte-level BPE
    b: bytes  # model of a piece BPE with byte fallback
    pattern: str  # splits a text before the merges of A


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256."""
    rest = sorted(set(range(256)).difference(_PLAIN))
    return {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace(SPACE, " ").encode()


class Pair:
    """Both tokenizers on a worker."""

    _last: tuple[bytes, Pair] | None = None

    def __init__(self, files: Files):
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in json.loads(files.a)["model"]["vocab"].items() if all(c in letters for c in token)}
        self.a = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = [*map(str, range(len(self.a_bytes)))], [*map(str, range(len(self.b_bytes)))]

    @classmethod
    def load(cls, files: Files) -> Pair:
        """The pair of these files, built once per worker process."""
        key = hashlib.sha256(files.a + files.b + files.pattern.encode()).digest()
        if cls._last is None or cls._last[0] != key:
            cls._last = (key, cls(files))
        return cls._last[1]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a space and the text by both; none if the text is empty or one of them does not give its bytes back."""
        if not text:
            return [], []
        want = b" " + text.encode()
        a = self.a.encode_ordinary(" " + text)
        if self.a.decode_bytes(a) != want:
            return [], []
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return [], []
        return a, b

    def cuts(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """Number of tokens of each side before every common end; tokens have a byte at least, so an end has one token."""
        ends_a = np.cumsum(self.a_size[np.array(a, np.int64)])
        ends_b = np.cumsum(self.b_size[np.array(b, np.int64)])
        if not len(ends_a) or not len(ends_b):
            return [], []
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
        common = np.flatnonzero(ends_b[at] == ends_a)
        return (common + 1).tolist(), (at[common] + 1).tolist()

    def group_text(self, a: list[int], b: list[int], a_cuts: list[int], b_cuts: list[int]) -> str:
        """The groups as text: ids by commas, sides by a bar, groups by semicolons."""
        x, y = [*map(self.a_text.__getitem__, a)], [*map(self.b_text.__getitem__, b)]
        out, p, q = [], 0, 0
        for i, j in zip(a_cuts, b_cuts, strict=True):
            left = x[p] if i - p == 1 else ",".join(x[p:i])
            right = y[q] if j - q == 1 else ",".join(y[q:j])
            out.append(f"{left}|{right}")
            p, q = i, j
        return ";".join(out)

    def links(self, a: list[int], b: list[int], a_cuts: list[int], b_cuts: list[int]) -> np.ndarray:
        """Links of all slices as id of A times size of B plus id of B: the tokens of a slice that end together are its last ones."""
        last_a = np.array(a, np.int64)[np.array(a_cuts, np.int64) - 1]
        last_b = np.array(b, np.int64)[np.array(b_cuts, np.int64) - 1]
        return last_a * len(self.b_bytes) + last_b


def read_files(a: str, b: str, pattern: str) -> Files:
    """Tokenizers from a JSON file of a byte-level BPE and a model file of a piece BPE."""
    with open(a, "rb") as one, open(b, "rb") as two:
        return Files(one.read(), two.read(), pattern)


def public_pair(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Files:
    import public_tokenizers

    return read_files(public_tokenizers.path(a), public_tokenizers.path(b), public_tokenizers.PATTERN)


def _lists(parts: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array(p, np.int32) for p in parts])))


def align(docs: DataFrame, files: Files) -> DataFrame:
    """All columns of docs and a_ids, b_ids, a_cuts, b_cuts; columns of these names are replaced.

    Group g holds the tokens from the previous cut (0 at first) up to cut g of
    each side. A null or empty text, and one that a tokenizer does not give
    back byte for byte after a leading space, has no tokens and no groups.
    Texts are encoded whole, special tokens are plain text, rows stand alone;
    an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(files)
    rest = others(docs, FOUND)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.load(shared.value)
        for batch in batches:
            texts, start, size, parts = batch.column(rest.index("text")), 0, 0, []
            for row, t in enumerate(texts):
                a, b = pair.encode(t.as_py() or "")
                parts.append((a, b, *pair.cuts(a, b)))
                size += 8 * (len(a) + len(b))
                if size >= OUT or row == len(texts) - 1:
                    held = [batch.column(i).slice(start, len(parts)) for i in range(len(rest))]
                    yield pa.record_batch([*held, *map(_lists, zip(*parts, strict=True))], [*rest, *FOUND])
                    start, size, parts = row + 1, 0, []

    return docs.select(*rest).mapInArrow(work, schema_with(docs, rest, ", ".join(f"{c} array<int>" for c in FOUND)))


_LINKED = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")


def linked(docs: DataFrame, files: Files) -> DataFrame:
    """doc_id, sizes, the digest of the groups and the packed links of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = schema_with(rows, ["doc_id"], "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.load(shared.value)

        def out(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*found, strict=True)]
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            return pa.record_batch([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *_LINKED])

        for batch in batches:
            texts, start, size, found = batch.column(1), 0, 0, []
            for row, t in enumerate(texts):
                a, b = pair.encode(t.as_py() or "")
                cuts = pair.cuts(a, b)
                digest = hashlib.sha256(pair.group_text(a, b, *cuts).encode()).hexdigest() if a else ""
                links = pair.links(a, b, *cuts).tobytes()
                found.append((len(a), len(b), len(cuts[0]), len(links) // 8, digest, links))
                size += len(links)
                if size >= OUT or row == len(texts) - 1:
                    yield out(batch.column(0).slice(start, len(found)), found)
                    start, size, found = row + 1, 0, []

    return rows.mapInArrow(work, schema)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of a binary column, and where each row's begin and the last one's end."""
    sizes = np.array([0, *[len(v.as_buffer()) // 8 for v in column]], np.int64)
    packed = b"".join(v.as_buffer() for v in column)
    return np.frombuffer(packed, np.int64), np.cumsum(sizes)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """Per linked id pair: pair (packed), count over all rows, and whether that is the highest of its B id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(_numbers(batch.column(0))[0], return_counts=True)
            yield pa.record_batch([pa.array(pairs), pa.array(n)], ["pair", "count"])

    parts = rows.select("links").mapInArrow(count, "pair long, count long")
    counts = cut_lineage(parts.groupBy("pair").agg(F.sum("count").alias("count")).withColumn("_b", F.col("pair") % b_size))
    top = counts.groupBy("_b").agg(F.max("count").alias("_top"))
    return counts.join(top, "_b").select("pair", "count", (F.col("count") == F.col("_top")).alias("best"))


def score_links(docs: DataFrame, files: Files, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link joins an A and a B token that end at the same byte; the count of its
    id pair is the number of links over all rows that hold it. n_best counts
    the links whose count is the highest of their B id, ties included;
    count_sum adds the counts over the links. Rows as in `align`; without
    tokens all numbers are zero and the digest is empty. A repeated document
    counts as often as it stands there, null ids stay null, other columns are
    ignored. Counts of more pairs than ``block`` are scored block by block.
    """
    spark = docs.sparkSession
    rows = cut_lineage(linked(docs, files))
    pairs = cut_lineage(pair_counts(rows, sentencepiece.SentencePieceProcessor(model_proto=files.b).get_piece_size()))
    blocks = max(1, -(-pairs.count() // block))
    at = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k) if blocks > 1 else pairs
        held = part.toArrow()
        codes = held.column("pair").to_numpy()
        order = np.argsort(codes)
        table = (codes[order], held.column("count").to_numpy()[order], held.column("best").to_numpy()[order])
        at = _scored(at, spark.sparkContext.broadcast(table))
        if k < blocks - 1:
            at = cut_lineage(at)
    return at.drop("links")


def _scored(rows: DataFrame, shared) -> DataFrame:
    """The rows with n_best and count_sum raised by the links of one block."""
    names = rows.columns
    links, best, total = (names.index(c) for c in ("links", "n_best", "count_sum"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, tops = shared.value
        for batch in batches:
            found, ends = _numbers(batch.column(links))
            columns = [*batch.columns]
            if len(found) and len(pairs):
                place = np.minimum(np.searchsorted(pairs, found), len(pairs) - 1)
                known = pairs[place] == found
                for column, value in ((best, tops[place] & known), (total, np.where(known, counts[place], 0))):
                    sums = np.concatenate(([0], np.cumsum(value, dtype=np.int64)))[ends]
                    columns[column] = pa.array(columns[column].to_numpy() + np.diff(sums))
            yield pa.record_batch(columns, names)

    return rows.mapInArrow(work, rows.schema)
