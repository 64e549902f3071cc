"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one per hashed word, pair of
neighbouring words and byte n-gram; a linear layer and softmax give the labels,
starting from their frequencies. The average counts a few empty features, so
short texts stay near the frequencies. A pair is hashed by the difference of
its words, so that every repeated word falls in one bucket. Training is
plain stochastic gradient descent in numpy on a bounded sample of labelled
documents, of which the driver gets only hashed feature counts. At scoring,
vectors and layer are multiplied out once into one number per bucket and
label, so a document costs one gather per feature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.text import mix64, others, schema_with
from tidefolio.llm.words import slices, word_hashes

BUCKETS = 1 << 16  # of words, and as many of n-grams
GRAM = 4
DIM = 16
SAMPLE = 8000  # labelled documents to learn from, at most
EPOCHS = 5
RATE = 0.3
EMPTY = 20  # features without a vector that every text has besides its own
SEED = 7


@dataclass
class Model:
    labels: list[int]
    table: np.ndarray  # bucket x label: vectors times layer
    bias: np.ndarray


def features(data: bytes, buckets: int = BUCKETS, gram: int = GRAM) -> Iterator[np.ndarray]:
    """Buckets of the text's words and byte n-grams, in pieces of bounded length."""
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for part in slices(data):
        words = word_hashes(part)
        if len(words):
            yield (words & np.uint64(buckets - 1)).astype(np.uint32)
            yield (mix64(np.diff(words)) & np.uint64(buckets - 1)).astype(np.uint32)
        a = np.frombuffer(part, np.uint8)
        if len(a) >= gram:
            h = np.zeros(len(a) - gram + 1, np.uint32)
            for i in range(gram):
                h = h * np.uint32(0x01000193) + a[i : len(a) - gram + 1 + i]
            yield ((h * np.uint32(0x9E3779B1)) >> shift) + np.uint32(buckets)


def counted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and how often each occurs."""
    at, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for piece in features(data):
        ids, m = np.unique(piece, return_counts=True)
        at, back = np.unique(np.concatenate((at, ids)), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate((n, m)), minlength=len(at)).astype(np.int64)
    return at, n


def sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Label and feature counts of at most `most` labelled training documents, chosen by a hash of the id."""
    chosen = (
        labels.where(training & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.where(training).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted((t.as_py() or "").encode()) for t in batch.column(2)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([pack(*f) for f in found], pa.binary()),
                ],
                ["doc_id", "label", "counts"],
            )

    got = rows.mapInArrow(count, "doc_id long, label int, counts binary").collect()
    got = sorted(((r["doc_id"], bytes(r["counts"]), r["label"]) for r in got), key=lambda r: r[:2])[:most]
    return [(label, *unpack(counts)) for _, counts, label in got]


def pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted buckets by their steps, then the counts, compressed for the way to the driver."""
    return zlib.compress(np.concatenate((np.diff(at, prepend=0), n)).astype("<u4").tobytes(), 1)


def unpack(counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = np.frombuffer(zlib.decompress(counts), "<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.uint32), n


def fit(rows, buckets=BUCKETS, dim=DIM, epochs=EPOCHS, rate=RATE, seed=SEED) -> Model:
    """Stochastic gradient descent on the cross-entropy, the rate falling to zero."""
    labels = sorted({r[0] for r in rows}) or [0, 1]
    place = {v: i for i, v in enumerate(labels)}
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (2 * buckets, dim)).astype(np.float32)
    layer = np.zeros((dim, len(labels)), np.float32)
    bias = np.log((np.bincount([place[r[0]] for r in rows], minlength=len(labels)) + 1) / (len(rows) + len(labels)))
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at, n = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            share = (n / (n.sum() + EMPTY)).astype(np.float32)
            doc = share @ vectors[at] if len(at) else np.zeros(dim, np.float32)
            logit = doc @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[place[label]] -= 1
            # an average of many vectors moves each of them little; the scale makes up for it
            vectors[at] -= lr * len(at) * np.outer(share, layer @ p) if len(at) else 0
            layer -= lr * np.outer(doc, p)
    return Model(labels, vectors @ layer, bias)


def probability(model: Model, data: bytes, label: int = 1) -> float:
    """Probability of the label; of a text without features, the label's frequency."""
    total, n = np.zeros(len(model.labels)), 0
    for piece in features(data, len(model.table) // 2):
        total += model.table[piece].sum(axis=0, dtype=np.float64)
        n += len(piece)
    logit = total / (n + EMPTY) + model.bias
    p = np.exp(logit - logit.max())
    return float(p[model.labels.index(label)] / p.sum()) if label in model.labels else 0.0


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs and score, the probability of label 1; a column of that name is replaced.

    A null text counts as empty. Rows are judged alone, so repeated rows agree
    and an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = others(docs, ("score",))
    schema = schema_with(docs, rest, "score double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = pa.array([probability(shared.value, (t.as_py() or "").encode()) for t in texts], pa.float64())
            yield pa.record_batch([*(batch.column(i) for i in range(len(rest))), found], [*rest, "score"])

    return docs.select(*rest).mapInArrow(judge, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str, training: Column, most: int = SAMPLE, **how) -> DataFrame:
    """Learn `label` from a sample of the training documents, then score every document."""
    return score(docs, fit(sample(docs, labels, label, training, most), **how))
