"""Phrase collocation mining by direct-address tiling.

The words of a language get ids by frequency. A phrase is a pair: the rank of
its first words, and the id of its last word. Pairs are dealt to square tiles;
a tile that many pairs of a buffer meet is counted as a dense table by
`bincount`, the rest as sorted coordinates with counts. Spark sums what the
tasks counted. The frequent pairs are ranked by frequency again and take the
place of the first word for phrases one word longer, up to the longest.

What the tasks look up has a fixed bound: at most ``words`` words and ``phrases``
phrases of each length, the most frequent ones. Phrases with a first part or a
last word beyond those are counted as texts, so a vocabulary of any size gives
whole and exact counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefolio.llm.text import LOWER_BYTES
from tidefolio.llm.words import slices
from tidefolio.operators.groups import top_rows
from tidefolio.session import cut_lineage

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
SHARE = 80  # per cent of its occurrences inside one longer phrase that drop a candidate
TOP = 2_000  # phrases per language
SCALE = 2_000_000
WORDS = 1 << 20  # words looked up by id, at most; about 150 MB in a worker
PHRASES = 1 << 21  # phrases of a length looked up by rank, at most; 32 MB
BITS = 20  # of a word's id in a pair
TILE = 1 << 10  # ids along the side of a tile
DENSE = TILE * TILE // 8  # pairs of a buffer from which a tile is a table
BUFFER = 1 << 22  # pairs of a buffer
HELD = 200_000  # texts counted in a task before they are passed on
BATCH = 1 << 19  # rows per result batch
UNKNOWN, BREAK = -1, -2
#: fixed values: bytes that end a piece; they become the first of them
ENDS = b".,;:!?\n\x0b\x0c\r"
_ENDED = LOWER_BYTES.translate(bytes.maketrans(ENDS, ENDS[:1] * len(ENDS)))
_END, _APART = ENDS[:1], b" " + ENDS[:1] + b" "


def tokens(data: bytes) -> Iterator[list[bytes]]:
    """Words in order, A-Z lower-cased, with a full stop wherever a piece ends; whole, in bounded slices."""
    for part in slices(data):
        yield part.translate(_ENDED).replace(_END, _APART).split()


@dataclass
class Level:
    """The most frequent phrases of one length, ranked by frequency."""

    codes: np.ndarray  # sorted; rank of the phrase without its last word << BITS | id of that word
    ranks: np.ndarray  # of each code
    whole: bool  # whether no other phrase of the length is frequent

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Ranks, -1 for a phrase that is not held."""
        if not len(self.codes):
            return np.full(len(codes), UNKNOWN, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.ranks[at], UNKNOWN)

    def by_rank(self) -> np.ndarray:
        out = np.empty(len(self.codes), np.int64)
        out[self.ranks] = self.codes
        return out


@dataclass
class Index:
    """Word ids by language and the levels found so far."""

    ids: dict[str, dict[bytes, int]]
    whole: bool
    levels: list[Level] = field(default_factory=list)


def phrase_codes(ids: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Per position the code of the phrase one word longer than the last level, -1 if it has none, and whether it may be frequent.

    A phrase may be frequent only if all shorter ones in it are; where a level
    holds all frequent phrases of its length, that is looked up.
    """
    longer = len(index.levels) + 2
    n = max(0, len(ids) - longer + 1)
    rank, maybe = ids, np.ones(n, bool)
    for i in range(longer):
        maybe &= ids[i : i + n] != BREAK
    for size in range(1, longer):
        known = rank >= 0
        if index.levels[size - 2].whole if size > 1 else index.whole:
            for i in range(longer - size + 1):
                maybe &= known[i : i + n]
        last = ids[size:]
        first = rank[: len(last)]
        codes = np.where((first >= 0) & (last >= 0), first << BITS | last, UNKNOWN)
        if size == longer - 1:
            return np.where(maybe, codes[:n], UNKNOWN), maybe
        held = codes >= 0
        rank = np.full(len(codes), UNKNOWN, np.int64)
        rank[held] = index.levels[size - 1].find(codes[held])
    raise AssertionError


def tile_counts(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct codes and their counts: full tiles as dense tables, the others as sorted coordinates."""
    if not len(codes):
        return
    across = int((codes & (1 << BITS) - 1).max()) // TILE + 1
    tile = (codes >> BITS) // TILE * across + (codes & (1 << BITS) - 1) // TILE
    full = np.bincount(tile) >= DENSE
    for t in np.flatnonzero(full).tolist():
        left, right = t // across * TILE, t % across * TILE
        inside = codes[tile == t]
        table = np.bincount(((inside >> BITS) - left) * TILE + (inside & (1 << BITS) - 1) - right)
        cells = np.flatnonzero(table)
        yield cells // TILE + left << BITS | cells % TILE + right, table[cells]
    rest = np.sort(codes[~full[tile]])
    if len(rest):
        starts = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1])))
        yield rest[starts], np.diff(np.append(starts, len(rest)))


def _rows(names: list[str], columns: list, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    for start in range(0, len(arrays[0]), BATCH):
        yield pa.record_batch([a.slice(start, BATCH) for a in arrays], names)


def _texts(counter: Counter) -> list[list]:
    keys = [*counter]
    return [[k[0] for k in keys], [k[1].decode() for k in keys], [counter[k] for k in keys]]


def _languages(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, c) over all rows; the empty word counts all words of its language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["lang", "word", "c"], [pa.string(), pa.string(), pa.int64()]
        held: dict[str, Counter] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, counter in held.items():
                yield from _rows(names, [[lang] * len(counter), [w.decode() for w in counter], [*counter.values()]], kinds)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counter = held.setdefault(lang, Counter())
                for found in tokens(text.as_py().encode()):
                    counter.update(found)
                    counter[b""] += len(found) - counter.pop(_END, 0)
                if sum(map(len, held.values())) > HELD:
                    yield from emit()
        yield from emit()

    return rows.mapInArrow(count, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def phrase_counts(rows: DataFrame, shared: Broadcast, loose: bool, longer: int) -> DataFrame:
    """Counts of phrases of ``longer`` words: by code, and with ``loose`` those without one by lang and phrase."""
    names = ["code", "lang", "phrase", "c"] if loose else ["code", "c"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        pending: list[np.ndarray] = []  # codes of a buffer
        texts: Counter = Counter()
        stop, waiting = np.array([BREAK], np.int64), 0

        def emit() -> Iterator[pa.RecordBatch]:
            for codes, n in tile_counts(np.concatenate(pending or [stop[:0]])):
                none = [None] * len(codes) if loose else []
                yield from _rows(names, [codes, *([none, none] if loose else []), n], [pa.int64(), *([pa.string()] * 2 if loose else []), pa.int64()])
            if texts:
                yield from _rows(names, [[UNKNOWN] * len(texts), *_texts(texts)], [pa.int64(), pa.string(), pa.string(), pa.int64()])
            pending.clear()
            texts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                find = index.ids.get(lang, {}).get
                parts, words = [], []
                for found in tokens(text.as_py().encode()):
                    ids = np.fromiter((BREAK if w == _END else UNKNOWN for w in found), np.int64, len(found)) if loose else None
                    known = np.fromiter(map(find, found, repeat(UNKNOWN)), np.int64, len(found))
                    parts.append(known if ids is None else np.where(ids == BREAK, BREAK, known))
                    if loose:
                        words += found
                codes, maybe = phrase_codes(np.concatenate([*parts, stop]), index)
                pending.append(codes[codes >= 0])
                waiting += len(pending[-1])
                if loose:
                    texts.update((lang, b" ".join(words[i : i + longer])) for i in np.flatnonzero(maybe & (codes < 0)).tolist())
                if waiting >= BUFFER or len(texts) > HELD:
                    yield from emit()
                    waiting = 0
        yield from emit()

    schema = "code long, lang string, phrase string, c long" if loose else "code long, c long"
    counted = rows.mapInArrow(count, schema)
    return counted.groupBy(*names[:-1]).agg(F.sum("c").alias("c"))


def most_frequent(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The rows of highest c, ``most`` at most, and whether these are all; rows of about the same c stay together.

    A histogram of counts by eighths of a power of two gives the border.
    """
    if rows.count() <= most:
        return rows, True
    step = F.floor(F.log2("c") * 8)
    total, border = 0, None
    for r in sorted(rows.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        total += r["count"]
        if total > most:
            break
        border = r["s"]
    return rows.where(step >= border if border is not None else F.lit(False)), False


def _ranked(rows: DataFrame, whole: bool) -> Level:
    held = rows.select("code", "c").toArrow()
    codes, c = held.column("code").to_numpy(), held.column("c").to_numpy()
    order = np.argsort(codes)
    codes, c = codes[order], c[order]
    ranks = np.empty(len(codes), np.int64)
    ranks[np.lexsort((codes, -c))] = np.arange(len(codes))
    return Level(codes, ranks, whole)


def _decoded(rows: DataFrame, names: Broadcast, above: Broadcast) -> DataFrame:
    """(lang, phrase, c) of coded rows; ``names``: languages and words by id, ``above``: codes by rank of the levels before."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words = (pa.array(column) for column in names.value)
        for batch in batches:
            rank, ids = batch.column(0).to_numpy(), []
            for codes in [None, *reversed(above.value)]:
                rank = rank if codes is None else codes[rank]
                ids.insert(0, rank & (1 << BITS) - 1)
                rank = rank >> BITS
            ids.insert(0, rank)
            phrase = pc.binary_join_element_wise(*[words.take(pa.array(i)) for i in ids], " ")
            yield pa.record_batch([langs.take(pa.array(ids[0])), phrase, batch.column(1)], ["lang", "phrase", "c"])

    return rows.select("code", "c").mapInArrow(decode, "lang string, phrase string, c long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, words: int = WORDS, phrases: int = PHRASES) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with ``least`` occurrences or more as (lang, size, phrase, c), and (lang, n), all words."""
    if least < 1 or words > 1 << BITS:
        raise ValueError(f"least {least} must be 1 or more, words {words} at most {1 << BITS}")
    spark, rows = docs.sparkSession, _languages(docs)
    singles = cut_lineage(word_counts(rows).where((F.col("c") >= least) | (F.col("word") == "")))
    totals = singles.where("word = ''").select("lang", F.col("c").alias("n"))
    singles = singles.where("word <> ''")
    head, whole = most_frequent(singles, words)
    held = head.toArrow().sort_by([("lang", "ascending"), ("c", "descending"), ("word", "ascending")])
    langs, texts = held.column("lang").to_pylist(), held.column("word").to_pylist()
    ids: dict[str, dict[bytes, int]] = {}
    for i, (lang, word) in enumerate(zip(langs, texts, strict=True)):
        ids.setdefault(lang, {})[word.encode()] = i
    names = spark.sparkContext.broadcast((langs, texts))
    index, found = Index(ids, whole), [singles.select("lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), "c")]
    for size in range(2, longest + 1):
        loose = not (index.whole and all(level.whole for level in index.levels))
        counts = phrase_counts(rows, spark.sparkContext.broadcast(index), loose, size)
        counts = cut_lineage(counts.where(F.col("c") >= least))
        coded = counts.where("code >= 0")
        above = spark.sparkContext.broadcast([level.by_rank() for level in index.levels])
        found.append(_decoded(coded, names, above).select("lang", F.lit(size).alias("size"), "phrase", "c"))
        if loose:
            found.append(counts.where("code < 0").select("lang", F.lit(size).alias("size"), "phrase", "c"))
        if size < longest:
            head, held_all = most_frequent(coded, phrases)
            level = _ranked(head, held_all and not loose)
            index = Index(ids, whole, [*index.levels, level])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return cut_lineage(every), totals


def _part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def score(phrases: DataFrame, share: int = SHARE, scale: int = SCALE) -> DataFrame:
    """Candidates with their lowest-scoring cut, without those that a longer phrase takes in: lang, phrase, a, l, r, score."""
    worded = phrases.withColumn("words", F.split("phrase", " ")).where("size > 1")
    cuts = worded.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select(
        "lang", "phrase", F.col("c").alias("a"), "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")
    )
    for side, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("c").alias(count)), ["lang", side])
    exact = f"cast(cast(a as decimal(19, 0)) * {scale} div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as long)"
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))

    inside = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(words, i, n), ' '))))")
    longer = worded.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "c")
    longer = longer.groupBy("lang", "phrase").agg(F.max("c").alias("longer"))
    taken = F.expr(f"cast(longer as decimal(19, 0)) * 100 >= cast(a as decimal(19, 0)) * {share}")
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(taken, F.lit(False)))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = TOP, share: int = SHARE, scale: int = SCALE, **how) -> DataFrame:
    """The first ``top`` collocations per language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at marks and line ends and
    into words at spaces and tabs; phrases lie within a piece. a is a phrase's
    count, l and r the counts of both parts of its lowest-scoring cut, n all
    words of the language, score floor(scale * a / (l + r)). A phrase inside a
    longer one of ``share`` per cent of its count or more is dropped. Order is
    by score, a, both descending, then phrase by bytes. A null lang is `und`, a
    null text empty; texts of any length are read whole, repeated documents
    count as often as they stand there, other columns are ignored; an empty
    table gives no row. ``how`` goes to `frequent_phrases`.
    """
    phrases, totals = frequent_phrases(docs, **how)
    scored = cut_lineage(score(phrases, share, scale))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = top_rows(scored, ["lang"], order, top, salt="phrase")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
