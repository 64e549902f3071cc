"""Byte-level BPE: encode with a given rank table, decode ids.

Two tiers per pre-token. A minimal perfect hash over the vocabulary tells
whether the whole pre-token is a token. If not, its bytes form a linked list
and a heap of adjacent pairs merges the lowest rank first, the leftmost among
equals, so a pre-token of n bytes takes n log n steps. The driver reads the
rank file and builds the hash; both are broadcast, and a vocabulary has a
fixed size whatever the documents.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.text import others, schema_with

MEMO = 150_000  # pre-tokens a worker remembers at least, twice as many at most
LOAD = 2  # keys per bucket of the perfect hash
OUT = 1 << 22  # bytes of text per result batch


@dataclass
class Vocabulary:
    pattern: str
    tokens: list[bytes]  # by id; a gap is empty
    ids: np.ndarray  # id by slot of the perfect hash
    shift: np.ndarray  # displacement by bucket
    pairs: dict[int, int]  # id of the token that two tokens make, by left << 20 | right


def _mixed(token: bytes, buckets: int) -> tuple[int, int, int]:
    h = xxhash.xxh64_intdigest(token, 1)
    return h % buckets, h >> 20, (h >> 40) | 1


def perfect_hash(tokens: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots 0 … n-1 for n tokens, none free: ids by slot and displacements by bucket.

    Full buckets come first and try displacements until their keys land on
    free slots; buckets of one key are given a free slot outright, as -1 - slot.
    """
    n = len(tokens)
    buckets = max(1, n // LOAD)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(buckets)]
    for token, i in tokens.items():
        b, start, step = _mixed(token, buckets)
        held[b].append((start, step, i))
    ids, shift, taken = np.zeros(n, np.int32), np.zeros(buckets, np.int64), bytearray(n)
    order = sorted(range(buckets), key=lambda b: -len(held[b]))
    for b in order:
        if len(held[b]) < 2:
            break
        d = 0
        while True:
            slots = {(start + d * step) % n for start, step, _ in held[b]}
            if len(slots) == len(held[b]) and not any(taken[s] for s in slots):
                break
            d += 1
        shift[b] = d
        for start, step, i in held[b]:
            s = (start + d * step) % n
            taken[s], ids[s] = 1, i
    free = (s for s in range(n) if not taken[s])
    for b in order:
        if len(held[b]) == 1:
            s = next(free)
            shift[b], ids[s] = -1 - s, held[b][0][2]
    return ids, shift


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Vocabulary from a rank file: base64 token and rank per line."""
    with open(path, "rb") as lines:
        tokens = {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines if line.strip())}
    by_id = [b""] * (max(tokens.values(), default=-1) + 1)
    for t, i in tokens.items():
        by_id[i] = t
    missing = [b for b in range(256) if bytes([b]) not in tokens]
    if missing:
        raise ValueError(f"no token for the single bytes {missing}")
    pairs = {}
    for t, i in tokens.items():
        for cut in range(1, len(t)):
            left, right = tokens.get(t[:cut]), tokens.get(t[cut:])
            if left is not None and right is not None:
                pairs[left << 20 | right] = i
    return Vocabulary(pattern, by_id, *perfect_hash(tokens), pairs)


class Encoder:
    """Encodes texts on a worker; remembers the pre-tokens it has met lately."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        self.tokens, self.memo, self.pairs = vocabulary.tokens, memo, vocabulary.pairs
        self.ids, self.shift = vocabulary.ids.tolist(), vocabulary.shift.tolist()
        self.bytes = [self.whole(bytes([i])) for i in range(256)]
        self.find = regex.compile(vocabulary.pattern).findall
        self.high = [b << 8 for b in range(256)].__getitem__
        self.start = [self.pairs.get(a << 20 | b, -1) for a in self.bytes for b in self.bytes]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, token: bytes) -> int:
        """Id of a whole token, -1 if it is none: one probe of the perfect hash and one comparison."""
        b, start, step = _mixed(token, len(self.shift))
        d = self.shift[b]
        i = self.ids[-1 - d if d < 0 else (start + d * step) % len(self.ids)]
        return i if self.tokens[i] == token else -1

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token by merging its bytes, lowest rank first."""
        n, pair, start = len(token), self.pairs.get, self.start
        bits = n.bit_length()
        part = [self.bytes[b] for b in token]  # id of the part that starts here; -1 once it is merged away
        rank = [start[x] for x in map(add, map(self.high, token), token[1:])]  # of the part and the next; -1 if they make no token
        rank.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        # an entry is rank and place in one number, so equal ranks come from the left
        heap = [r << bits | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & (1 << bits) - 1
            r = x >> bits
            if rank[i] != r:
                continue  # one of the two parts has changed since
            j = after[i]
            part[i], part[j], rank[i], rank[j] = r, -1, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := pair(r << 20 | part[k])) is not None:
                    rank[i] = q
                    heappush(heap, q << bits | i)
            h = before[i]
            if h >= 0:
                if (q := pair(part[h] << 20 | r)) is not None:
                    rank[h] = q
                    heappush(heap, q << bits | h)
                else:
                    rank[h] = -1
        return [i for i in part if i >= 0]

    def encode(self, text: str) -> np.ndarray:
        known, older, found = self.known, self.older, self.find(text)
        for word in set(found).difference(known):
            ids = older.get(word)
            if ids is None:
                raw = word.encode()
                i = self.whole(raw)
                ids = array("i", (i,) if i >= 0 else self.merge(raw)).tobytes()
            known[word] = ids
        out = np.frombuffer(b"".join(map(known.__getitem__, found)), np.int32)
        if len(known) > self.memo:
            self.known, self.older = {}, known
        return out


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, text: str, rest: list[str], ids: str) -> Iterator[pa.RecordBatch]:
    """The columns `rest`, which come first, and the ids of the texts, in slices of a few megabytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        start, size, parts = 0, 0, []
        for row, t in enumerate(texts):
            parts.append(encoder.encode(t.as_py() or ""))
            size += 4 * len(parts[-1])
            if size >= OUT or row == len(texts) - 1:
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
                held = [batch.column(i).slice(start, len(parts)) for i in range(len(rest))]
                yield pa.record_batch([*held, lists], [*rest, ids])
                start, size, parts = row + 1, 0, []


def _decoded(batches: Iterator[pa.RecordBatch], tokens: list[bytes], ids: str, rest: list[str], out: str) -> Iterator[pa.RecordBatch]:
    """The columns `rest`, which come first, and the bytes of the ids, in slices of a few megabytes."""
    token = tokens.__getitem__
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(ids))
        start, size, parts = 0, 0, []
        for row, v in enumerate(lists):
            parts.append(b"".join(map(token, v.values.to_numpy(zero_copy_only=False).tolist())) if v.is_valid else b"")
            size += len(parts[-1])
            if size >= OUT or row == len(lists) - 1:
                held = [batch.column(i).slice(start, len(parts)) for i in range(len(rest))]
                yield pa.record_batch([*held, pa.array(parts, pa.binary())], [*rest, out])
                start, size, parts = row + 1, 0, []


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs and the text's token ids as an array; a column named `ids` is replaced.

    Null counts as empty; an empty text has no id. Special tokens are plain
    text. Rows are encoded alone and whole; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rest = others(docs, (ids.lower(),))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, Encoder(shared.value), text, rest, ids)

    return docs.select(*rest).mapInArrow(work, schema_with(docs, rest, f"`{ids}` array<int>"))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of docs and the bytes of the token ids; a column named `out` is replaced. Null ids decode to nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    rest = others(docs, (out.lower(),))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, shared.value, ids, rest, out)

    return docs.select(*rest).mapInArrow(work, schema_with(docs, rest, f"`{out}` binary"))


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encode`, then `decode` of its ids, by one worker per task: two at once would each hold a vocabulary and batches."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rest = others(docs, (ids.lower(), out.lower()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _encoded(batches, Encoder(shared.value), text, rest, ids)
        return _decoded(coded, shared.value.tokens, ids, [*rest, ids], out)

    return docs.select(*rest).mapInArrow(work, schema_with(docs, rest, f"`{ids}` array<int>, `{out}` binary"))


def digests() -> list[Column]:
    """Count and digests of the columns `ids` and `decoded`."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids and the decoded bytes of every document."""
    return encode_decode(docs.select("doc_id", "text"), vocabulary).drop("text")


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)
