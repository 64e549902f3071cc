"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken of all training rows on the executors and summed per language
and bucket by Spark, so the driver sees at most languages x buckets numbers.
The log-probability matrix is broadcast: its size is fixed by the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.text import others, schema_with
from tidefolio.session import cut_lineage

SIZES = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.1
MAX_LANGUAGES = 256
UNKNOWN = "und"
CHARS = 1 << 19  # characters worked on at once
TERMS = 1 << 21  # numbers of a batch's product, about
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray  # per language
    log_prob: np.ndarray  # bucket x language
    sizes: tuple[int, ...] = SIZES


def _letters() -> np.ndarray:
    """Which code points are letters; built once per worker."""
    if not hasattr(_letters, "table"):
        _letters.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters.table


def ngram_buckets(text: str, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the text's character n-grams, in pieces of bounded length.

    Texts are lower-cased and every run of other characters than letters is
    one space; n-grams of spaces alone are left out.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for its run
    codes = np.concatenate(([32], np.where(letter, codes, 32)[keep], [32])).astype(np.uint32)
    if len(codes) > 2 and codes[-2] == 32:
        codes = codes[:-1]
    longest = max(sizes)
    for at in range(0, len(codes), CHARS):
        part = codes[at : at + CHARS + longest - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            m = min(CHARS, len(part) - n + 1)
            if m <= 0:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in sizes:
                g = h[:m] ^ (h[:m] >> np.uint32(15))
                g = g * np.uint32(0x85EBCA6B)
                g ^= g >> np.uint32(13)
                yield (g & np.uint32(buckets - 1))[part[:m] != 32] if n == 1 else g & np.uint32(buckets - 1)


def sparse_counts(text: str, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in the text, ascending, and how often each does."""
    total: np.ndarray | None = None
    for piece in ngram_buckets(text, sizes, buckets):
        n = np.bincount(piece, minlength=buckets)
        total = n if total is None else total + n
    at = np.flatnonzero(total)
    return at, total[at]


def train(docs: DataFrame, training: Column, sizes=SIZES, buckets=BUCKETS, smoothing=SMOOTHING, max_languages=MAX_LANGUAGES) -> Model:
    """Fit on `text` and `lang` of all rows where `training` holds and both are there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in seen.items():
                at = np.flatnonzero(counts)
                yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at - 1), pa.array(counts[at])], ["lang", "bucket", "n"])
            seen.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                if lang.as_py() not in seen and len(seen) >= 64:
                    yield from flush()
                counts = seen.setdefault(lang.as_py(), np.zeros(buckets + 1, np.int64))
                at, n = sparse_counts(text.as_py(), sizes, buckets)
                counts[at + 1] += n
                counts[0] += 1  # documents
        yield from flush()

    rows = docs.where(training & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    summed = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = cut_lineage(summed)
    if summed.where("bucket = -1").count() > max_languages:
        raise ValueError(f"over {max_languages} values of lang; raise max_languages if they are languages")
    got = summed.toPandas()  # at most max_languages x (buckets + 1) rows
    languages = sorted(got["lang"].unique())
    counts = np.zeros((buckets + 1, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[got["bucket"].to_numpy() + 1, got["lang"].map(place).to_numpy(int)] = got["n"].to_numpy()
    docs_of, grams = counts[0], counts[1:] + smoothing
    return Model(languages, np.log(docs_of / max(docs_of.sum(), 1)), np.log(grams / grams.sum(axis=0)).astype(np.float32), tuple(sizes))


def log_posteriors(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Text x language: log prior and the sparse counts of all texts times the log-probability matrix."""
    out = np.tile(model.log_prior, (len(rows), 1))
    sizes = [len(at) for at, _ in rows]
    if sum(sizes):
        terms = model.log_prob[np.concatenate([at for at, _ in rows])] * np.concatenate([n for _, n in rows])[:, None]
        some = np.flatnonzero(sizes)  # reduceat takes no empty rows
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out[some] += np.add.reduceat(terms, starts[some], axis=0)
    return out


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Most probable language of each text and its posterior; `und` and 0 without a letter or without a learned language."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    part: list[int] = []
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    terms = 0
    for i, text in enumerate(texts):
        if text and model.languages and _LETTER.search(text):
            part.append(i)
            rows.append(sparse_counts(text, model.sizes, len(model.log_prob)))
            terms += len(rows[-1][0]) * len(model.languages)
        if part and (terms >= TERMS or i == len(texts) - 1):
            logs = log_posteriors(model, rows)
            best = logs.argmax(axis=1)
            shares = 1 / np.exp(logs - logs[np.arange(len(part)), best][:, None]).sum(axis=1)
            for k, b, share in zip(part, best.tolist(), shares.tolist(), strict=True):
                langs[k], scores[k] = model.languages[b], share
            part, rows, terms = [], [], 0
    return langs, scores


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs and lang_pred, score; a column of such a name is replaced.

    Null texts and texts without a letter are `und` with score 0. Each row is
    judged alone, so repeated rows agree and an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = others(docs, ("lang_pred", "score"))
    schema = schema_with(docs, rest, "lang_pred string, score double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = score_texts(shared.value, batch.column(batch.schema.get_field_index(text)).to_pylist())
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.record_batch([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    return docs.select(*rest).mapInArrow(score, schema)


def identify(docs: DataFrame, training: Column, **fit) -> DataFrame:
    """Learn from the training rows' text and lang and predict every row."""
    return predict(docs, train(docs, training, **fit))


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """Documents with a predicted language, with all their columns; without a learned language those with a letter.

    The model names the likeliest of its languages for every text with a
    letter, so it is such texts that stay: a null text and one without a letter
    go, rows without ids, repeated rows and texts of any length are judged by
    their text alone, and an empty table gives no row.
    """
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[[c.lower() for c in docs.columns].index("text")]))
    found = predict(plain, model).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
